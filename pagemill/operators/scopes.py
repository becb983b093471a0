"""Scopes and addresses as tables: which hosts are inside which domains, and whether all addresses of a host may be fetched."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import texts, urls


def suffixes(host: Column) -> Column:
    """The host and what is left of it behind each of its dots; an address is only itself, and nothing is below one."""

    def cut(h: Column) -> Column:
        labels = F.split(h, r"\.")
        each = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        return F.when(urls.is_ip(h), F.array(h)).otherwise(F.filter(each, lambda d: ~urls.is_ip(d)))

    return texts.bound(host, cut)


def within(hosts: DataFrame, host: str, scopes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hosts with scope: the narrowest domain of scopes (by ..., domain) that the host is, or is below; null for none.

    Each distinct host is met with its own suffixes, an equality join, so that any number of domains costs what the hosts' labels
    cost. Null hosts and null values of ``by`` have no scope. Rows of hosts stay as they are."""
    by = by or []
    keys = [*by, host]
    tails = hosts.select(*keys).where(F.col(host).isNotNull()).distinct().select(*keys, F.explode(suffixes(F.col(host))).alias("domain"))
    met = tails.join(scopes.select(*by, "domain").distinct(), [*by, "domain"]).groupBy(*keys).agg(F.max_by("domain", F.length("domain")).alias("scope"))
    return hosts.join(met, keys, "left")


def narrowed(spec: DataFrame, recipe: DataFrame, by: str) -> DataFrame:
    """(by, domain): what two tables of scopes share, by the narrower of each pair of domains that overlap; all of spec where
    recipe has no domain for that value of ``by``."""
    a, b = spec.select(by, "domain").distinct(), recipe.select(by, "domain").distinct()
    of_spec = within(a.withColumnRenamed("domain", "own"), "own", b, [by]).where("scope IS NOT NULL")
    of_recipe = within(b.withColumnRenamed("domain", "own"), "own", a, [by]).where("scope IS NOT NULL")
    free = a.join(b.select(by).distinct(), by, "left_anti")
    return of_spec.select(by, F.col("own").alias("domain")).union(of_recipe.select(by, F.col("own").alias("domain"))).union(free).distinct()


def address_bits(address: Column) -> Column:
    """The 128 bits of an address as digits, null for what is none. IPv4, and what stands for it, has its mapped form."""
    digits = urls.routing_digits(address)
    bits = lambda d: F.array_join(F.transform(F.split(d, ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    return texts.bound(digits, lambda d: F.when(d.isNotNull(), bits(d)))


def network_rows(nets: dict[str, str | None]) -> list[tuple[int, str, str | None]]:
    """(length, prefix, reason) of networks as text; reason None lets a network in."""
    out = []
    for net, why in nets.items():
        at = ipaddress.ip_network(net)
        width, shift = (at.prefixlen, 0) if at.version == 6 else (at.prefixlen + 96, 0xFFFF << 32)
        out.append((width, f"{int(at.network_address) | shift:0128b}"[:width], why))
    return out


def denied_networks(spark: SparkSession) -> DataFrame:
    """(length, prefix, reason) of the networks that may not be fetched. Those of IPv4 lie in a network that may, inside one that may not."""
    return spark.createDataFrame(network_rows(urls.DENIED | urls.DENIED6 | {"0.0.0.0/0": None}), "length int, prefix string, reason string")


def routable(resolved: DataFrame, networks: DataFrame, host: str = "host", address: str = "address") -> DataFrame:
    """(host, addresses, denied, reason, allowed): a row for each host of resolved (host, address), one row an address.

    Each distinct address is met with networks (length, prefix, reason) by its leading bits, an equality join for each length that
    occurs (129 at most); the longest decides, and a null reason there allows. What is no address counts as "invalid". allowed: the host
    has an address, and none is denied. reason: the least of those denied. An address that many hosts share is judged once."""
    pairs = resolved.select(F.col(host).alias("host"), F.col(address).alias("address")).distinct()
    lengths = sorted(r[0] for r in networks.select("length").distinct().collect())  # 129 at most
    each = pairs.select("address").where("address IS NOT NULL").distinct().withColumn("bits", address_bits(F.col("address")))
    heads = F.transform(F.lit(lengths).cast("array<int>"), lambda n: F.struct(n.alias("length"), F.substring(F.col("bits"), F.lit(1), n).alias("prefix")))
    cut = each.where("bits IS NOT NULL").select("address", F.explode(heads).alias("x")).select("address", "x.*")
    best = cut.join(networks, ["length", "prefix"]).groupBy("address").agg(F.max_by("reason", "length").alias("reason"))
    judged = each.join(best, "address", "left").select("address", F.when(F.col("bits").isNull(), "invalid").otherwise(F.col("reason")).alias("reason"))
    out = pairs.join(judged, "address", "left").groupBy("host").agg(F.count("address").alias("addresses"), F.count("reason").alias("denied"), F.min("reason").alias("reason"))
    return out.withColumn("allowed", (F.col("addresses") > 0) & (F.col("denied") == 0))
