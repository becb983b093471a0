"""The live tail of a log: batches, restarts, failures, and what is in the files."""

import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagemill.streaming import tail
from pagemill.streaming.events import EVENTS

AT = dt.datetime(2024, 1, 2, 3, 4, 5, 6000)


def put(spark, folder, ids, type_="page.fetched", files=1):
    rows = [(i, AT, "j", type_, f"u{i}", None, 1, '{"n":1}') for i in ids]
    spark.createDataFrame(rows, EVENTS).repartition(files).write.mode("append").parquet(str(folder / "log"))


def drain(spark, folder, cursor=-1, broken=None):
    """All that is there, batch by batch; ids in the order of their batches."""
    got = []

    def take(batch, n):
        got.append((n, sorted(r.event_id for r in batch.collect())))
        if broken:
            raise RuntimeError(broken)

    q = tail.follow(spark, str(folder / "log"), cursor).writeStream.foreachBatch(take).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return got


def test_goes_on_behind_the_last_id(spark, tmp_path):
    put(spark, tmp_path, range(10), files=3)
    assert [i for _, ids in drain(spark, tmp_path) for i in ids] == list(range(10))
    assert [ids for _, ids in drain(spark, tmp_path) if ids] == []  # nothing new
    put(spark, tmp_path, range(10, 15))
    put(spark, tmp_path, range(15, 40), files=4)
    assert sorted(i for _, ids in drain(spark, tmp_path) for i in ids) == list(range(10, 40))


def test_a_batch_that_fails_comes_again_and_only_it(spark, tmp_path):
    put(spark, tmp_path, range(5))
    drain(spark, tmp_path)
    put(spark, tmp_path, range(5, 9))
    with pytest.raises(Exception, match="lost"):
        drain(spark, tmp_path, broken="lost")
    put(spark, tmp_path, range(9, 12))  # comes after the batch was planned
    assert [ids for _, ids in drain(spark, tmp_path)] == [[5, 6, 7, 8]]
    assert [ids for _, ids in drain(spark, tmp_path)] == [[9, 10, 11]]


def test_begins_behind_a_cursor_and_in_a_folder_that_is_missing(spark, tmp_path):
    assert [ids for _, ids in drain(spark, tmp_path, 6) if ids] == []
    put(spark, tmp_path, range(10))
    assert [i for _, ids in drain(spark, tmp_path, 6) for i in ids] == [7, 8, 9]


def test_row_groups_nulls_repeats_and_other_columns(spark, tmp_path):
    (tmp_path / "log" / "_temporary").mkdir(parents=True)
    t = pa.table({"event_id": pa.array([1, 2, 2, None, 5, 6], pa.int64()), "job_id": ["a"] * 6, "extra": [0] * 6, "type": ["x"] * 6})
    pq.write_table(t, tmp_path / "log" / "a.parquet", row_group_size=2)
    pq.write_table(t, tmp_path / "log" / "b.parquet", write_statistics=False)
    (tmp_path / "log" / "_temporary" / "c.parquet").write_bytes(b"half")
    assert sorted(i for _, ids in drain(spark, tmp_path, 1) for i in ids) == [2, 2, 2, 2, 5, 5, 6, 6]


def test_only_row_groups_within_reach_are_read(tmp_path):
    pq.write_table(pa.table({"event_id": pa.array(range(100), pa.int64())}), tmp_path / "a.parquet", row_group_size=10)
    reader = tail.TailReader(str(tmp_path), -1, None)
    assert reader.latestOffset() == {"event_id": 99}
    assert [g.group for g in reader.partitions({"event_id": 39}, {"event_id": 60})] == [4, 5, 6]


def test_frames(spark):
    rows = [(7, AT, "j", "page.failed", "u", None, None, '{"b": [1, "x"]}'), (8, None, "j", "job.completed", None, None, None, None), (9, AT, "k", None, None, None, None, 'no "json"')]
    got = {r.event_id: r.frame for r in tail.frames(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got[7] == 'id: 7\nevent: page.failed\ndata: {"id":7,"event_type":"page.failed","payload":{"b":[1,"x"]},"created_at":"2024-01-02T03:04:05.006000"}\n\n'
    assert got[8] == 'id: 8\nevent: job.completed\ndata: {"id":8,"event_type":"job.completed"}\n\nevent: end\ndata: {}\n\n'
    assert json.loads(got[9].split("data: ")[1])["payload"] == 'no "json"' and got[9].startswith("id: 9\nevent: message\n")
