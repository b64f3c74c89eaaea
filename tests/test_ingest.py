from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, tables
from tidemark.sources import files

HEAD = "timestamp,outcomeId,marketId,contractSeries,league,marketType,tradeType,legs,cost,qty,side,extra"
A, B = "01900000-0000-7000-8000-00000000000a", "01900000-0000-7000-8000-00000000000b"


def csv(tmp_path, *lines, head=HEAD):
    (tmp_path / "trades.csv").write_text("\n".join([head, *lines]) + "\n")
    return str(tmp_path / "trades.csv")


def line(ts="2026-10-05T17:03:11.123Z", market=A, side="TAKER", qty="10", cost="4.5", legs="1", league="NFL"):
    return f"{ts},{B},{market},S,{league},,STRAIGHT,{legs},{cost},{qty},{side},x"


def test_types_row_numbers_and_ambiguity(spark, tmp_path):
    path = csv(tmp_path, line(), line(side="MAKER"), line(), line(market=B), line("2026-10-05T17:03:12Z", league=""))
    got = ingest.parse_trades(files.trades_csv(spark, path)).orderBy("row_num").collect()
    assert [r["row_num"] for r in got] == [1, 2, 3, 4, 5]
    assert [r["taker_count"] for r in got] == [2, 2, 2, 1, 1]
    assert [r["ambiguous"] for r in got] == [True, True, True, False, False]
    assert got[0]["price"] == 0.45 and got[4]["league"] is None and got[0]["market_type"] is None


def test_missing_columns_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="marketId, side"):
        files.trades_csv(spark, csv(tmp_path, head=HEAD.replace("marketId,", "").replace("side,", "")))


@pytest.mark.parametrize(
    ("bad", "message"),
    [(line(side="X"), "side"), (line("2026-10-05T17:03:11.12Z"), "timestamp"), (line(market="nope"), "marketId"), (line(legs="two"), "number"), (line(cost=""), "number"), (line(qty="0"), "qty"), (line(cost="-1"), "cost")],
)
def test_bad_rows(spark, tmp_path, bad, message):
    with pytest.raises(ingest.InvalidRows, match=message) as e:
        ingest.parse_trades(files.trades_csv(spark, csv(tmp_path, line(), bad, bad)))
    assert "2 rows" in str(e.value) and "[2, 3]" in str(e.value)


def test_replacing_a_day_leaves_other_days(spark, tmp_path):
    rows = ingest.parse_trades(files.trades_csv(spark, csv(tmp_path, line(), line(side="MAKER"))))
    out = str(tmp_path / "table")
    tables.write_day(ingest.for_day(rows, date(2026, 10, 5)), out)
    tables.write_day(ingest.for_day(rows, date(2026, 10, 6)), out)
    tables.write_day(ingest.for_day(rows.limit(1), date(2026, 10, 5)), out)
    stored = files.stored_trades(spark, out)
    assert {r["file_date"]: r["n"] for r in stored.groupBy("file_date").agg(F.count("*").alias("n")).collect()} == {date(2026, 10, 5): 1, date(2026, 10, 6): 2}


def test_missing_days(spark):
    days = spark.createDataFrame([(date(2026, 10, d),) for d in (2, 4, 5)], "day date")
    assert [r[0] for r in ingest.missing_days(days).collect()] == [date(2026, 10, 3)]
    assert ingest.missing_days(days.limit(0)).count() == 0


def test_index_dates(spark):
    html = '<a href="/reporting/trade-data/2026-10-05/trades.csv"><a href="/reporting/trade-data/2026-10-05/markets.csv"><a href="/reporting/trade-data/2026-10-04/trades.csv">'
    assert sorted(r[0].day for r in files.index_dates(spark.createDataFrame([(html,), (html,)], "html string")).collect()) == [4, 5]


def test_upserts(spark):
    schema = "event_id string, sport string, league string, status string, description string, starts_at timestamp, synced_at timestamp"
    old = spark.createDataFrame([("a", "f", "L1", "open", "d", None, None), ("b", "f", "L1", "open", "d", None, None)], schema)
    new = spark.createDataFrame([("a", "g", "L2", "done", None, None, None), ("c", "g", "L2", "open", "d", None, None)], schema)
    got = {r["event_id"]: r for r in tables.upsert_events(old, new).collect()}
    assert (got["a"]["league"], got["a"]["status"], got["a"]["description"]) == ("L1", "done", None)
    assert got["b"]["status"] == "open" and got["c"]["league"] == "L2"


def test_upsert_files_clears_loaded_at_when_the_size_changes(spark):
    s = "file_date date, etag string, size_bytes bigint, row_count int, downloaded_at timestamp, loaded_at timestamp"
    from datetime import datetime

    t = datetime(2026, 1, 1)
    old = spark.createDataFrame([(date(2026, 1, 1), "e", 5, 3, t, t), (date(2026, 1, 2), "e", 5, 3, t, t)], s)
    new = spark.createDataFrame([(date(2026, 1, 1), None, 5, None, t, None), (date(2026, 1, 2), "f", 6, None, t, None)], s)
    got = {r["file_date"].day: r for r in tables.upsert_files(old, new).collect()}
    assert (got[1]["etag"], got[1]["loaded_at"], got[2]["etag"], got[2]["loaded_at"]) == ("e", t, "f", None)


def test_post_items(spark):
    from tidemark import schemas

    rows = [("12", "full", "t", "Fri Nov 24 17:49:36 +0000 2023", None, True, None), (None, None, None, None, None, None, None), ("x1", "a", None, None, None, None, None), ("13", "", "short", None, None, None, ("other",))]
    got = {r["post_id"]: r for r in files.post_items(spark.createDataFrame(rows, schemas.POST_ITEM), "me").collect()}
    assert set(got) == {12, 13} and got[12]["text"] == "full" and got[13]["text"] == "short" and got[13]["account"] == "other" and got[12]["is_quote"] and not got[12]["is_retweet"]


def test_paged_source(spark):
    from tidemark.sources.pages import follow, offsets

    data = [{"id": f"{n:012x}"} for n in range(25, 0, -1)]
    fetch = offsets(lambda at, size: data[at : at + size])
    assert len(list(follow(fetch, 10))) == 25
    assert len(list(follow(fetch, 10, since_ms=20))) == 6


def test_checksums_and_compare(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    got = files.file_checksums(spark, str(tmp_path)).collect()
    assert [(r["size"], r["md5"]) for r in got] == [(5, "5d41402abc4b2a76b9719d911017c592")]


def test_weeks(spark):
    from datetime import datetime

    from tidemark.operators import weeks

    w = weeks.weekly_windows(spark, date(2026, 8, 4), date(2026, 8, 20))
    assert [(r["since"].day, r["until"].day) for r in w.orderBy("since").collect()] == [(4, 11), (11, 18), (18, 21)]
    from tidemark import schemas

    runs = [("Me", "2026-08-04", "2026-08-11", "r1", "SUCCEEDED", 10, 9, {"x": 2}, 0.5, None, True, None), ("me", "2026-08-11", "2026-08-18", "r2", "FAILED", None, None, {"x": 1, "y": 5}, 0.25, None, True, None)]
    led = spark.createDataFrame(runs, schemas.RUN_LEDGER)
    assert [r["since"].day for r in weeks.unfetched(w, led, "ME").orderBy("since").collect()] == [11, 18]
    assert tuple(weeks.ledger_totals(led).collect()[0]) == ("me", 2, 10, 9, 0.75)
    assert [tuple(r) for r in weeks.other_authors(led).collect()] == [("y", 5), ("x", 3)]
    posts = spark.createDataFrame([(datetime(2026, 8, 4), False), (datetime(2026, 8, 10, 23), True), (datetime(2026, 8, 20), False)], "t0 timestamp, is_retweet boolean")
    assert [tuple(r) for r in weeks.weekly_counts(w, posts).orderBy("label").collect()] == [("2026-08-04 to 2026-08-10", 2, 1), ("2026-08-11 to 2026-08-17", 0, 0), ("2026-08-18 to 2026-08-20", 1, 1)]


def test_convert_and_errors(spark, tmp_path):
    got = files.convert(spark, csv(tmp_path, line(), line(side="MAKER")), str(tmp_path / "p"), date(2026, 10, 5))
    assert got.count() == 2 and got.first()["source"] == "public_csv"
    (tmp_path / "s.jsonl").write_text('{"recv_ts": 5, "conn": "c", "msg": {"code": "E1", "message": "bad"}}\n{"recv_ts": 6, "conn": "c", "msg": {"ts": 1}}\n')
    assert [tuple(r) for r in files.stream_errors(files.stream_files(spark, str(tmp_path / "s.jsonl"))).collect()] == [(5, "error", "c", "E1: bad")]
