"""Small written-out inputs for operators that the driver's tables have no rows for."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

KICKOFF = datetime(2026, 10, 4, 17, 0, tzinfo=UTC)


def uid(when: datetime, n: int) -> str:
    """A version 7 UUID made at a time."""
    h = f"{int(when.timestamp() * 1000):012x}"
    return f"{h[:8]}-{h[8:]}-7000-8000-{n:012x}"


def posts(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "Sam Carter (ankle) ruled out for Week 4."),
        (2, "Reporter: Bears WR Lou Hart (hip) doubtful for Week 2."),
        (3, "Status alert: Max Stone (knee) won't return Sunday."),
        (4, "Ann's view: Jo Park could return soon."),
        (5, "Packers RB Al Reed (toe), TE Bo Lind (rib) and QB Cy Moon questionable for preseason Week 1"),
        (6, "Ed Fox traded to the Bucs."),
    ]
    return spark.createDataFrame(rows, "post_id bigint, text string")


def games(spark: SparkSession) -> DataFrame:
    week = timedelta(days=7)
    rows = [("g1", KICKOFF - week, "Chicago Bears @ Green Bay Packers"), ("g2", KICKOFF, "Detroit Lions @ Chicago Bears"), ("g3", KICKOFF + week, "Chicago Bears @ Minnesota Vikings"), ("f1", KICKOFF, "Season winner")]
    return spark.createDataFrame(rows, "event_id string, starts_at timestamp, description string")


def markets(spark: SparkSession) -> DataFrame:
    early, late = KICKOFF - timedelta(days=9), KICKOFF - timedelta(days=2)
    rows = [
        (uid(early, 1), "g1", "RECEIVING_YARDS", "Lou Hart Jr. 55.5 RECEIVING_YARDS"),
        (uid(late, 2), "g2", "RECEIVING_YARDS", "Lou Hart 60.5 RECEIVING_YARDS"),
        (uid(early, 3), "g2", "MONEY", "Detroit Lions @ Chicago Bears MONEY"),
        (uid(late, 4), "g2", "RUSHING_YARDS", "Dan Wolf 40.5 RUSHING_YARDS"),
    ]
    return spark.createDataFrame(rows, "market_id string, event_id string, market_type string, description string")


def subjects(spark: SparkSession) -> DataFrame:
    t0 = KICKOFF - timedelta(hours=3)
    rows = [(1, t0, ["Lou Hart"], None), (2, t0, ["Lou Hart"], "Vikings"), (3, t0, ["No Body", "Dan Wolf"], None), (4, t0, ["No Body"], "Bears"), (5, t0 + timedelta(days=60), ["Lou Hart"], "Bears")]
    return spark.createDataFrame(rows, "post_id bigint, t0 timestamp, players array<string>, team string")


def moments(spark: SparkSession) -> DataFrame:
    rows = [("Lou Hart", "Bears", "doubtful", KICKOFF - timedelta(hours=2), KICKOFF, ["Lions", "Bears"]), ("Lou Hart", "Bears", "out", KICKOFF - timedelta(hours=2), KICKOFF, ["Lions", "Bears"]), ("Ann Low", None, "out", KICKOFF + timedelta(hours=1), KICKOFF, ["Lions", "Bears"])]
    return spark.createDataFrame(rows, "subject string, team string, status string, t0 timestamp, game_start timestamp, game_teams array<string>")


def side_markets(spark: SparkSession) -> DataFrame:
    rows = [
        ("m1", "RECEIVING_YARDS", "Lou Hart 60.5 RECEIVING_YARDS", [("o1", "Over 60.5"), ("o2", "Under 60.5")]),
        ("m2", "MONEY", "Lions @ Bears", [("o3", "DET Lions"), ("o4", "CHI Bears")]),
        ("m3", "SPREAD_1H", "Lions @ Bears", [("o5", "DET -3.5"), ("o6", "CHI 3.5")]),
        ("m4", "TOTAL", "Lions @ Bears", [("o7", "Over 44.5"), ("o8", "Under 44.5")]),
        ("m5", "TEAM_TOTAL", "CHI Bears 20.5 TEAM_TOTAL", [("o9", "Over 20.5"), ("o10", "Under 20.5")]),
        ("m6", "TEAM_TOTAL", "DET Lions 24.5 TEAM_TOTAL", [("o11", "Over 24.5"), ("o12", "Under 24.5")]),
    ]
    return spark.createDataFrame(rows, "market_id string, market_type string, description string, outcomes array<struct<outcomeId:string,name:string>>")


def journal(spark: SparkSession) -> DataFrame:
    rows = [
        (1000, "start", None, 2, None, None), (1100, "covered", 0, None, ["a"], None), (1200, "covered", 1, None, ["b"], None), (1300, "seq_gap", 0, None, None, "m1"), (1400, "resynced", 0, None, None, "m1"),
        (1500, "disconnected", 1, None, None, None), (1600, "covered", 1, None, ["b"], None), (1700, "seq_gap", 1, None, None, "m2"), (1800, "stop", None, None, None, None),
    ]
    lines = [("prod", n, *r) for n, r in enumerate(rows)]
    return spark.createDataFrame(lines, "env string, line int, ts bigint, kind string, slot int, slots int, events array<string>, market string").selectExpr("*", "cast(null as string) as detail")
