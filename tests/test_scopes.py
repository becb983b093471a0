"""Scopes and addresses as tables, held against the rules for one at a time."""

import ipaddress
import random
from collections import defaultdict

from pagemill.functions import urls
from pagemill.operators import scopes

NAMES = ["example.com", "a.example.com", "b.a.example.com", "notexample.com", "com", "example.org", "10.0.0.1", "1.0.0.1", "::1", "x.10.0.0.1", "EXAMPLE.com", ""]


def test_within_and_narrowed_as_by_lists(spark):
    rng = random.Random(3)
    hosts = [(i % 4 if i % 7 else None, rng.choice([*NAMES, None])) for i in range(200)]
    table = [(i % 4, rng.choice(NAMES)) for i in range(14)] + [(0, NAMES[0]), (0, NAMES[0])]
    df = spark.createDataFrame(hosts, "crawl int, host string").repartition(3)
    allowed = spark.createDataFrame(table, "crawl int, domain string")
    below = lambda h, d: h == d or (not urls.is_address(h) and not urls.is_address(d) and h.endswith("." + d))

    def widest(crawl, host):
        found = [d for c, d in table if c == crawl and host is not None and below(host, d)]
        return max(found, key=len, default=None)

    got = sorted(map(str, scopes.within(df, "host", allowed, ["crawl"]).select("crawl", "host", "scope").collect()))
    want = spark.createDataFrame([(c, h, widest(c, h)) for c, h in hosts], "crawl int, host string, scope string").collect()
    assert got == sorted(map(str, want))
    names = [n for n in NAMES if n]
    a = [(i % 3, rng.choice(names)) for i in range(15)] + [(9, "free.com")]
    b = [(i % 3, rng.choice(names)) for i in range(9)]
    lists = lambda rows: {c: tuple(dict.fromkeys(d for x, d in rows if x == c)) for c, _ in rows}
    got = defaultdict(set)
    for r in scopes.narrowed(spark.createDataFrame(a, "crawl int, domain string"), spark.createDataFrame(b, "crawl int, domain string"), "crawl").collect():
        got[r.crawl].add(r.domain)
    assert got == {c: set(x) for c, spec in lists(a).items() if (x := urls.narrowed(spec, lists(b).get(c, ())))}


def test_addresses_as_one_at_a_time(spark):
    rng = random.Random(8)
    some = [str(ipaddress.IPv4Address(rng.randrange(1 << 32))) for _ in range(150)] + [str(ipaddress.ip_network(n)[k]) for n in [*urls.DENIED, *urls.DENIED6] for k in (0, -1)]
    some += [f"::ffff:{ipaddress.IPv4Address(rng.randrange(1 << 32))}" for _ in range(40)] + [str(ipaddress.IPv6Address(rng.randrange(1 << 128))) for _ in range(80)] + ["2002:7f00:1::", "::7f00:1", "no", "", "1.2.3", "[::1]"]
    df = spark.createDataFrame([(a, a) for a in some], "host string, address string")
    rows = df.withColumn("one", urls.denied_address(df.address)).withColumn("bits", scopes.address_bits(df.address)).collect()
    one = {r.host: r.one if r.bits else "invalid" for r in rows}
    got = {r.host: r for r in scopes.routable(df, scopes.denied_networks(spark)).collect()}
    assert {h: r.reason for h, r in got.items()} == one
    assert all((r.addresses, r.allowed) == (1, one[h] is None) for h, r in got.items())


def test_one_verdict_a_host(spark):
    rows = [("a", "8.8.8.8"), ("a", "8.8.8.8"), ("a", "2606:4700::1"), ("b", "8.8.8.8"), ("b", "10.0.0.1"), ("c", None), (None, "1.1.1.1")]
    got = {r.host: (r.addresses, r.denied, r.reason, r.allowed) for r in scopes.routable(spark.createDataFrame(rows, "host string, address string"), scopes.denied_networks(spark)).collect()}
    assert got == {"a": (2, 0, None, True), "b": (2, 1, "private", False), "c": (0, 0, None, False), None: (1, 0, None, True)}
