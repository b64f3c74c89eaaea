"""Row numbers of split files, gzip members, paged sources."""

import gzip
import json
import random
import time
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests import paging
from tidemark.sources import files, pages


@pytest.fixture
def small_blocks(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_row_numbers_of_files_in_many_blocks(spark, tmp_path, small_blocks):
    for name, n in (("a", 3000), ("b", 7), ("c", 900)):
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "".join(f"{name}{k},{'z' * (k % 13)}\n" for k in range(n)))
    raw = spark.read.option("header", True).csv(str(tmp_path))
    assert raw.rdd.getNumPartitions() > 10
    got = files.numbered(raw).collect()
    assert len(got) == 3907 and all(int(r["x"][1:]) + 1 == r["row_num"] for r in got)


def test_line_numbers_skip_blank_lines_alike(spark, tmp_path, small_blocks):
    lines = [json.dumps({"ts": k, "kind": "heartbeat"}) + ("\n\n" if k % 5 == 0 else "\n") for k in range(800)]
    (tmp_path / "j.jsonl").write_text("".join(lines))
    got = files.journal(spark, str(tmp_path)).collect()
    assert sorted((r["ts"], r["line"]) for r in got) == [(k, k + 1) for k in range(800)]


def test_gzip_members(spark, tmp_path):
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(5000)), b"", b"a" * 3_000_000]
    packed = [gzip.compress(p) for p in parts]
    flipped = bytearray(packed[0])
    flipped[len(flipped) // 2] ^= 1
    wrong_crc = packed[2][:-8] + bytes([packed[2][-8] ^ 1]) + packed[2][-7:]
    cases = {"good": b"".join(packed), "cut": packed[0] + packed[2][:-3], "header": packed[0] + packed[2][:5], "bad": packed[1] + bytes(flipped), "crc": wrong_crc + packed[0], "tail": packed[0] + b"garbage", "zeros": b"\0" * 40, "empty": b""}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    content = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))
    rows = files.gzip_members(content).collect()
    by = {n: [r for r in sorted(rows, key=lambda r: r["member"]) if r["path"] == n] for n in cases}
    assert [(r["size"], r["crc32"], r["packed"], r["verdict"]) for r in by["good"]] == [(len(p), zlib.crc32(p), len(z), "ok") for p, z in zip(parts, packed, strict=True)]
    assert {n: [r["verdict"] for r in by[n]] for n in cases} == {"good": ["ok"] * 3, "cut": ["ok", "truncated"], "header": ["ok", "truncated"], "bad": ["ok", "corrupt"], "crc": ["corrupt"], "tail": ["ok", "trailing"], "zeros": ["corrupt"], "empty": []}
    got = {r["path"]: (r["members"], r["verdict"]) for r in files.archive_verdicts(content).collect()}
    assert got["good"] == (3, "ok") and got["cut"] == (2, "truncated") and got["tail"] == (2, "trailing") and "empty" not in got


@pytest.fixture
def paged(spark):
    """The calls so far; workers import the page readers from the folder that the tests run in."""
    where = Path(paging.COUNTS)
    where.mkdir(exist_ok=True)
    for name in ("calls", "items"):
        (where / name).unlink(missing_ok=True)
    spark.dataSource.register(pages.Paged)
    return lambda: (where / "calls").read_text().split("\n")[:-1] if (where / "calls").exists() else []


def test_a_cutoff_is_pushed_into_the_paging(spark, paged):
    was = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("paged").option("fetcher", "tests.paging:newest").option("size", 50).load().filter("ms >= 9000").collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", was)
    assert sorted(r["ms"] for r in got) == list(range(9000, 10_001, 10))
    assert len(paged()) == 3  # of twenty pages


def test_a_stream_goes_on_after_its_cursor(spark, paged, tmp_path):
    items = Path(paging.COUNTS) / "items"
    items.write_text(" ".join(map(str, range(1, 8))))

    def run(expect):
        q = spark.readStream.format("paged").option("fetcher", "tests.paging:growing").option("size", 3).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        end = time.time() + 60
        while time.time() < end and (not (tmp_path / "out" / "_spark_metadata").exists() or spark.read.schema("value string, ms bigint").parquet(str(tmp_path / "out")).count() < expect):
            time.sleep(0.5)
        q.stop()

    run(7)
    before = len(paged())
    items.write_text(" ".join(map(str, range(1, 12))))
    run(11)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["ms"] for r in rows) == list(range(1, 12))
    # page readers start from the last cursor again, never from the first
    assert all(int(c.split()[1]) >= 6 for c in paged()[before:])


def test_catalogue_items(spark):
    items = spark.createDataFrame([(json.dumps({"eventId": "e1", "league": "L", "status": "OPEN", "description": "a @ b", "startsTs": 5, "more": 1}),), (json.dumps({"eventId": "e2", "league": "L"}),), ("no json",)], "value string")
    markets = spark.createDataFrame([(json.dumps({"eventId": "e1"}),), (json.dumps({"eventId": "e1"}),), (json.dumps({"other": 1}),)], "value string")
    assert [tuple(r) for r in pages.catalogue_counts(items, markets).select("eventId", "league", "startsTs", "markets").collect()] == [("e1", "L", 5, 2)]
