from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar, teams


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_post_time(spark):
    got = values(spark, [(1,), ((5000 << 22) + 77,)], "id bigint", scalar.post_time(F.col("id")))
    assert got[0][0] == datetime(2010, 11, 4, 1, 42, 54, 657000)
    assert got[1][0] == datetime(2010, 11, 4, 1, 42, 59, 657000)
    for bad in (0, -5):
        with pytest.raises(Exception, match="not a post id"):
            values(spark, [(bad,)], "id bigint", scalar.post_time(F.col("id")))


def test_uuid7_time(spark):
    assert values(spark, [("01900000-0000-7000-8000-000000000001",)], "u string", F.unix_millis(scalar.uuid7_time(F.col("u")))) == [(0x019000000000,)]


def test_season_week_uses_the_league_zone(spark):
    rows = [("2026-09-08 03:59:00",), ("2026-09-08 04:00:00",), ("2026-09-15 03:30:00",), ("2026-09-15 04:30:00",)]
    got = values(spark, rows, "t string", scalar.season_week(F.col("t").cast("timestamp"), date(2026, 9, 8), "America/New_York"))
    assert [g[0] for g in got] == [None, 1, 1, 2]


def test_trade_time_and_numbers(spark):
    got = values(spark, [("2026-10-05T17:03:11.123Z",), ("2026-10-05T17:03:11Z",), ("2026-10-05T17:03:11.12Z",), ("2026-10-05 17:03:11Z",)], "t string", scalar.trade_time(F.col("t")))
    assert [g[0] for g in got] == [datetime(2026, 10, 5, 17, 3, 11, 123000), datetime(2026, 10, 5, 17, 3, 11), None, None]
    assert [g[0] for g in values(spark, [("1.5",), ("1d",), (" 1 ",), (".5e1",)], "t string", scalar.number(F.col("t")))] == [1.5, None, None, 5.0]


def test_scraped_time(spark):
    assert values(spark, [("Fri Nov 24 17:49:36 +0000 2023",), ("nonsense",)], "t string", scalar.scraped_time(F.col("t"))) == [(datetime(2023, 11, 24, 17, 49, 36),), (None,)]


def test_normalize_name(spark):
    rows = [("Odell Beckham Jr.",), ("José  Núñez-Ruiz III",), ("D'Andre O’Neil",), (None,)]
    assert [g[0] for g in values(spark, rows, "n string", scalar.normalize_name(F.col("n")))] == ["odell beckham", "jose nunez ruiz", "dandre oneil", None]


def test_prop_player_and_game_lines(spark):
    rows = [("Al Reed 89.5 RECEIVING_YARDS", "RECEIVING_YARDS"), ("Al Reed -1 X", "X"), ("A @ B MONEY", "MONEY"), ("A @ B SPREAD_1H", "SPREAD_1H"), (" X", "X"), ("Al Reed 3", "X")]
    got = values(spark, rows, "d string, m string", scalar.prop_player(F.col("d"), F.col("m")), scalar.is_game_line(F.col("m")))
    assert got == [("Al Reed", False), ("Al Reed", False), (None, True), (None, True), (None, False), (None, False)]


def test_team_functions(spark):
    t = teams.game_teams(F.col("d"))
    assert [g[0] for g in values(spark, [("Chicago Bears @ Green Bay Packers",), ("Bears",), ("A @ B",)], "d string", t)] == [["Bears", "Packers"], None, None]
    assert [g[0] for g in values(spark, [("Bucs",), ("Niners",), ("Bears",), ("x",), (None,)], "d string", teams.canonical_team(F.col("d")))] == ["Buccaneers", "49ers", "Bears", None, None]
    assert [g[0] for g in values(spark, [("GB -3", "Packers"), ("Green Bay Packers", "Packers"), ("CHI", "Packers"), ("x", None)], "d string, t string", teams.starts_with_team(F.col("d"), F.col("t")))] == [True, True, False, False]


def test_first_line(spark):
    rows = [(" A is out, per @some_one.\nmore",), ("Jo Day inactive https://t.co/x1",), ("B active via the broadcast",), ("",)]
    assert [g[0] for g in values(spark, rows, "t string", scalar.first_line(F.col("t")))] == ["A is out.", "Jo Day inactive", "B active", ""]


def test_etag_quantile_cost(spark):
    assert [g[0] for g in values(spark, [('"' + "a" * 32 + '"',), ("b" * 32,), ('"x-2"',)], "e string", scalar.md5_of_etag(F.col("e")))] == ["a" * 32, "b" * 32, None]
    assert values(spark, [([3.0, 1.0, 2.0, None],), ([],)], "x array<double>", scalar.nearest_quantile(F.filter("x", lambda v: v.isNotNull()), 0.9)) == [(3.0,), (None,)]
