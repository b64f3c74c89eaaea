"""Tables by hash buckets: batches that come twice or broke off, and what an upsert rewrites."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tables
from tidemark.streaming import jobs

EVENTS = "event_id string, league string, status string, description string, starts_at timestamp_ntz, synced_at bigint"


def rows(spark, ids, status, at):
    return spark.createDataFrame([(f"e{i}", f"{status}l", status, "x", None, at) for i in ids], EVENTS)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.glob("bucket=*/*.parquet")}


def state(spark, path):
    return {r["event_id"]: (r["league"], r["status"], r["synced_at"]) for r in tables.read_keyed(spark, str(path), spark.createDataFrame([], EVENTS).schema).collect()}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    path = tmp_path / "t"
    put = lambda df, batch: tables.upsert_keyed(df, str(path), ["event_id"], tables.upsert_events, batch, 100)
    assert state(spark, path) == {}
    put(rows(spark, range(1000), "open", 1), "0")
    before = files(path)
    assert len(before) == 100
    put(rows(spark, [3, 77, 5000], "done", 2), "1")
    changed = {f.split("/")[0] for f in set(files(path)) - set(before)}
    assert 1 <= len(changed) <= 3 and len(files(path)) == 100
    got = state(spark, path)
    assert len(got) == 1001 and got["e3"] == ("openl", "done", 2) and got["e4"] == ("openl", "open", 1) and got["e5000"] == ("donel", "done", 2)
    before = files(path)
    put(rows(spark, range(1000), "late", 9), "1")  # a batch that is in the ledger
    assert files(path) == before and state(spark, path) == got
    assert sorted(p.name for p in (path / "_ledger").iterdir()) == ["batch=0", "batch=1"] and not list((path / "_staged").iterdir())


@pytest.mark.parametrize("breaks", ["write_keyed", "rule"])
def test_a_batch_that_broke_off_is_finished(spark, tmp_path, monkeypatch, breaks):
    path = tmp_path / "t"
    tables.upsert_keyed(rows(spark, range(50), "open", 1), str(path), ["event_id"], tables.upsert_events, "0", 10)
    seen = state(spark, path)

    def fails(*_):
        raise OSError("lost")

    with pytest.raises(OSError), monkeypatch.context() as m:
        if breaks == "write_keyed":
            m.setattr(tables, "write_keyed", fails)
        tables.upsert_keyed(rows(spark, range(40, 60), "done", 2), str(path), ["event_id"], fails if breaks == "rule" else tables.upsert_events, "1", 10)
    assert state(spark, path) == seen
    tables.upsert_keyed(rows(spark, range(40, 60), "done", 2), str(path), ["event_id"], tables.upsert_events, "1", 10)
    got = state(spark, path)
    assert len(got) == 60 and got["e45"] == ("openl", "done", 2) and got["e55"] == ("donel", "done", 2) and got["e1"] == seen["e1"]


def test_a_stream_of_upserts(spark, tmp_path):
    source = tmp_path / "in"
    for at in (1, 2):
        df = rows(spark, range(at * 10), f"s{at}", at).unionByName(rows(spark, [0], "last", 50 + at))
        df.coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(source))
    run = lambda checkpoint: jobs.upsert_stream(stream, str(tmp_path / "t"), ["event_id"], tables.upsert_events, "synced_at", str(tmp_path / checkpoint), 8).awaitTermination(120)
    run("cp")
    got = state(spark, tmp_path / "t")
    assert len(got) == 20 and got["e0"][1:] == ("last", 52) and got["e15"] == ("s2l", "s2", 2)
    before = files(tmp_path / "t")
    run("cp")  # nothing new
    run("other")  # all batches again under a new checkpoint: the ledger knows them
    assert files(tmp_path / "t") == before and state(spark, tmp_path / "t") == got


def test_rows_of_one_bucket_are_read(spark, tmp_path):
    tables.write_keyed(rows(spark, range(100), "open", 1), str(tmp_path / "t"), ["event_id"], 4)
    df = spark.read.parquet(str(tmp_path / "t")).filter(F.col("bucket").isin([1]))
    assert len(df.inputFiles()) == 4 and "PartitionFilters: [" in df._jdf.queryExecution().toString() and df.count() < 60
