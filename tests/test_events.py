"""The event sink over batches, restarts and failures."""

import pytest
from pyspark.sql import functions as F

from pagemill.streaming import events as ev


def put(spark, folder, rows):
    spark.createDataFrame(rows, ev.EVENTS).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def sink(spark, folder, files=1):
    ev.drain(ev.sink_events(ev.read_events(spark, str(folder / "in"), files), str(folder / "out"), str(folder / "cp")))
    read = lambda name: spark.read.parquet(str(folder / "out" / name))
    return read("events"), read("records"), read("tallies")


def found(i, job, url, payload):
    return (i, None, job, "records.extracted", url, None, 1, payload)


def test_one_record_of_each_identity_over_batches_and_restarts(spark, tmp_path):
    put(spark, tmp_path, [found(1, "j", "u", '{"a": 1, "b": [2]}'), (2, None, "j", "page.failed", "v", "http_4xx", None, None)])
    put(spark, tmp_path, [found(3, "j", "u", '{"b": [2], "a": 1}'), found(3, "j", "u", '{"b": [2], "a": 1}'), (2, None, "j", "page.failed", "v", "http_4xx", None, None)])
    events, records, _ = sink(spark, tmp_path)  # a batch for each file
    assert [tuple(r) for r in records.select("job_id", "url", "data").collect()] == [("j", "u", '{"a":1,"b":[2]}')]
    assert sorted(r.event_id for r in events.collect()) == [1, 2, 3]
    # started anew, with the same record on another page, in another job, and once more where it was
    put(spark, tmp_path, [found(4, "j", "u", '[{"a":1,"b":[2]}, {"a":2}]'), found(5, "k", "u", '{"a":1,"b":[2]}'), found(6, "j", "w", '{"a":1,"b":[2]}')])
    events, records, tallies = sink(spark, tmp_path)
    assert sorted(tuple(r) for r in records.select("job_id", "url", "data").collect()) == [("j", "u", '{"a":1,"b":[2]}'), ("j", "u", '{"a":2}'), ("j", "w", '{"a":1,"b":[2]}'), ("k", "u", '{"a":1,"b":[2]}')]
    assert events.count() == 6 and "payload" not in events.columns
    summed = tallies.groupBy("job_id", "type", "reason").agg(F.sum("n").alias("n"), F.sum("count").alias("count")).collect()
    assert {(r.job_id, r.type, r.reason): (r.n, r["count"]) for r in summed} == {("j", "page.failed", "http_4xx"): (1, None), ("j", "records.extracted", None): (4, 4), ("k", "records.extracted", None): (1, 1)}


def test_a_batch_that_fails_is_run_again_and_doubles_nothing(spark, tmp_path, monkeypatch):
    put(spark, tmp_path, [found(1, "j", "u", '{"a":1}')])
    sink(spark, tmp_path)
    put(spark, tmp_path, [found(2, "j", "u", '{"a":1}'), found(3, "j", "u", '{"a":2}')])
    real, broken = ev._start, []

    def breaking(rows, write, checkpoint, interval):
        def once(batch, n):
            write(batch, n)
            broken.append(n)
            raise RuntimeError("lost after the write, before the commit")

        return real(rows, once, checkpoint, interval)

    monkeypatch.setattr(ev, "_start", breaking)
    with pytest.raises(Exception, match="lost after the write"):
        sink(spark, tmp_path)
    monkeypatch.undo()
    for q in spark.streams.active:
        q.stop()
    assert broken
    events, records, tallies = sink(spark, tmp_path)
    assert sorted(r.data for r in records.collect()) == ['{"a":1}', '{"a":2}']
    assert sorted(r.event_id for r in events.collect()) == [1, 2, 3] and tallies.agg(F.sum("n")).first()[0] == 3


def test_nulls_and_what_is_no_json(spark, tmp_path):
    put(spark, tmp_path, [(None, None, None, "records.extracted", None, None, None, p) for p in (None, "{", "{", "[]", "[null, 1]", '"x"')])
    events, records, tallies = sink(spark, tmp_path)
    assert sorted(r.data for r in records.collect()) == ['"x"', "1", "null", "{"]
    assert events.count() == 1  # of one job and id, both null


def test_store_setting_is_put_back(spark, tmp_path):
    before = spark.conf.get(ev.STORE, None)
    put(spark, tmp_path, [found(1, "j", "u", "{}")])
    sink(spark, tmp_path)
    assert spark.conf.get(ev.STORE, None) == before


def test_payloads_are_dealt_before_they_are_parsed(spark, tmp_path, monkeypatch):
    put(spark, tmp_path, [found(i, "j", f"u{i % 5}", f'[{{"a":{i}}}, {{"a":{i + 1}}}, 3]') for i in range(50)])
    plans, real = {}, ev._start

    def noted(rows, write, checkpoint, interval):
        plans[checkpoint.rsplit("/", 1)[-1]] = (rows.columns, rows._jdf.queryExecution().analyzed().toString())
        return real(rows, write, checkpoint, interval)

    monkeypatch.setattr(ev, "_start", noted)
    events, records, _ = sink(spark, tmp_path)
    above, below = plans["records"][1].split("Repartition", 1)
    assert above.count("parse_json") == 1 and "parse_json" not in below  # by all tasks, once a payload
    assert "payload" not in plans["events"][0]
    assert events.count() == 50 and "payload" not in events.columns
    want = {(f"u{i % 5}", f'{{"a":{j}}}') for i in range(50) for j in (i, i + 1)} | {(f"u{u}", "3") for u in range(5)}
    got = [(r.url, r.data) for r in records.collect()]
    assert set(got) == want and len(got) == len(want)
