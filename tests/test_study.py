from datetime import UTC, datetime, timedelta
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, events, fit, measure, study, summary
from tidemark.plans.params import Params

T0 = datetime(2026, 10, 4, 17, 0, tzinfo=UTC)
P = Params()
TRADES = "ts timestamp, market_id string, outcome_id string, side string, price double, qty double, cost double, ambiguous boolean"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def taker(seconds, price, qty, outcome="yes", ambiguous=False):
    return (at(seconds), "m", outcome, "TAKER", float(price), float(qty), float(price * qty), ambiguous)


def maker(seconds, price, qty, outcome="no", ambiguous=False):
    return (at(seconds), "m", outcome, "MAKER", float(price), float(qty), float(price * qty), ambiguous)


def moments(spark, expected=None, game_start=None, start=T0):
    return spark.createDataFrame([(1, "m", "yes", start, game_start, expected)], "post_id bigint, market_id string, favored_id string, at timestamp, game_start timestamp, expected_move double")


def run(spark, rows, **kw):
    end = kw.pop("data_end", None)
    return measure.measure(moments(spark, **kw), spark.createDataFrame(rows, TRADES), ["post_id", "market_id"], P, end).collect()[0]


def test_last_price_is_the_volume_weighted_last_time_strictly_before(spark):
    rows = [taker(-900, 0.3, 5), taker(-60, 0.44, 10), taker(-60, 0.48, 30), taker(-30, 0.9, 1, "no"), taker(0, 0.99, 1)]
    prints = asof.taker_prints(spark.createDataFrame(rows, TRADES))
    m = moments(spark).withColumnRenamed("favored_id", "outcome_id")
    got = asof.last_price(m, prints, ["post_id"], P.lookback).collect()[0]
    assert got["price"] == pytest.approx(0.47)
    assert got["price_ts"] == at(-60).replace(tzinfo=None)
    assert asof.last_price(m, prints, ["post_id"], P.lookback, inclusive=True).collect()[0]["price"] == pytest.approx(0.99)
    assert asof.last_price(m, prints.filter("ts > '2027-01-01'"), ["post_id"], P.lookback).collect()[0]["price"] is None


def test_measure_with_makers_and_an_ambiguous_group(spark):
    rows = [
        taker(-1200, 0.40, 10), taker(-60, 0.45, 10), taker(5, 0.5, 20), maker(5, 0.5, 20), taker(20, 0.53, 10), maker(20, 0.47, 10), taker(100, 0.52, 25, ambiguous=True), taker(500, 0.6, 30),
        maker(500, 0.48, 5), maker(500, 0.36, 25), taker(700, 0.6, 1), taker(1800, 0.65, 1), taker(3700, 0.9, 1),
    ]
    r = run(spark, rows)
    assert r["excluded"] is None
    assert (r["pre_price"], r["lead_price"], r["post_price"]) == pytest.approx((0.45, 0.40, 0.65))
    assert r["drift"] == pytest.approx(0.05)
    assert r["moved"] and r["recent_pre_trade"]
    assert (r["xp_fills"], r["xp_first_s"], r["xp_last_s"]) == (4, 5, 500)
    assert (r["xp_qty"], r["xp_ambiguous_qty"], r["xp_qty_upper"]) == (35, 25, 60)
    assert [r[f"xp_qty_{b}"] for b in ("0_10s", "10_30s", "30_60s", "1_5m", "5_10m")] == [20, 10, 0, 0, 5]
    assert r["t0_fills"] is None


def test_expected_move_view(spark):
    rows = [taker(-60, 0.45, 10), taker(5, 0.48, 20), maker(5, 0.52, 20), taker(1800, 0.46, 1)]
    assert run(spark, rows, expected=0.10)["t0_fills"] == 1
    assert run(spark, rows, expected=0.03)["t0_fills"] == 0
    assert run(spark, rows, expected=-0.01)["t0_fills"] is None
    assert run(spark, rows)["moved"] is False


def test_fill_exactly_at_the_moment_and_at_the_window_end_count(spark):
    rows = [taker(-60, 0.45, 10), taker(0, 0.46, 1), maker(0, 0.54, 1), taker(600, 0.46, 2), maker(600, 0.54, 2), taker(1800, 0.65, 1)]
    r = run(spark, rows)
    assert (r["xp_fills"], r["xp_qty_5_10m"], r["xp_last_s"]) == (2, 2, 600)


def test_exclusions(spark):
    ok = [taker(-60, 0.45, 10), taker(1800, 0.65, 1)]
    assert run(spark, ok, data_end=datetime(2026, 10, 4, 17, 30))["excluded"] == measure.DATA_ENDS
    assert run(spark, ok, game_start=at(-P.game_length - 60))["excluded"] == measure.GAME_ENDS
    short = run(spark, ok, game_start=at(-P.game_length + 2400))
    assert short["excluded"] is None and short["post_cut_short"]
    assert run(spark, [taker(1800, 0.65, 1)])["excluded"] == measure.NO_PRE
    old = run(spark, [taker(-2000, 0.45, 10)])
    assert (old["excluded"], old["pre_price"], old["moved"]) == (measure.OLD_PRE, 0.45, None)


def test_range_join_meets_each_pair_once(spark):
    rows = [taker(s, 0.5, 1) for s in range(-7200, 7201, 600)]
    got = asof.range_join(moments(spark), spark.createDataFrame(rows, TRADES).drop("qty", "cost"), ["market_id"], F.col("at") - F.expr("interval 1 hour"), F.col("at") + F.expr("interval 1 hour"), 1000)
    assert got.count() == 13


def test_running_medians_against_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, m = 40, 30
        settled, moves, posts, times = rng.integers(0, 50, n), rng.normal(size=n), rng.integers(0, 12, n), rng.integers(0, 60, m)
        got = fit.running_medians(times, settled, moves, posts, 5)
        for t, g in zip(times, got, strict=True):
            before = settled < t
            want = np.median(moves[before]) if len(set(posts[before])) >= 5 else np.nan
            assert np.isnan(g) == np.isnan(want) and (np.isnan(g) or g == pytest.approx(want))


def fit_table(spark, rows):
    return spark.createDataFrame(rows, "post_id bigint, market_id string, status string, kind string, tier1 boolean, at timestamp, week int, move double, excluded string, post_cut_short boolean")


def test_expected_moves_ladder(spark):
    day = timedelta(days=1)
    rows = [(n, "m", "out", "game_line", True, T0 - (10 - n) * day, 3, 0.10 + 0.01 * n, None, False) for n in range(5)]
    rows += [(8, "m", "out", "game_line", True, T0 - 9 * day, None, 0.9, None, False), (9, "m", "out", "game_line", True, T0 - timedelta(minutes=59), 3, 0.9, None, False), (10, "m", "out", "game_line", True, T0 - 2 * day, 3, 0.9, None, True)]
    known = fit.fit_rows(fit_table(spark, rows), P)
    targets = fit_table(spark, [(100, "a", "out", "game_line", True, T0, 3, None, None, None), (101, "b", "out", "player_prop", False, T0, 3, None, None, None), (102, "c", "doubtful", "game_line", True, T0, 3, None, None, None), (103, "d", "out", "game_line", True, T0, 1, None, None, None)])
    got = {r["post_id"]: r["expected_move"] for r in fit.expected_moves(targets, known, ["post_id"], P).collect()}
    assert got[100] == pytest.approx(0.12) and got[101] == pytest.approx(0.12)
    assert got[102] is None and got[103] is None
    control = {r["post_id"]: r["expected_move"] for r in fit.expected_moves(targets, known, ["post_id"], P, control=True).collect()}
    assert control[102] == pytest.approx(0.12)


def test_overlap_keeps_the_first_of_close_posts(spark):
    minutes = [(1, "a", 0), (2, "a", 3), (3, "a", 70), (4, "b", 75), (5, "b", 78), (6, "a", 130)]
    rows = spark.createDataFrame([(p, e, at(60 * m)) for p, e, m in minutes], "post_id bigint, event_id string, t0 timestamp")
    assert sorted(r[0] for r in events.drop_overlapping(rows, ["event_id"], 3600).select("post_id").collect()) == [1, 3, 4]
    assert sorted(r[0] for r in events.drop_overlapping(rows, ["event_id"], 3600, keep=False).select("post_id").collect()) == [2, 5, 6]


def test_quiet_is_two_sided_and_strict(spark):
    m = spark.createDataFrame([("s", at(0)), ("s", at(10_000)), ("u", at(0))], "who string, t0 timestamp")
    posts = spark.createDataFrame([("s", at(3599)), ("s", at(10_000 + 3600)), ("s", at(10_000 - 3600))], "who string, t0 timestamp")
    assert sorted((r["who"], r["t0"].hour) for r in events.quiet(m, posts, ["who"], 3600).collect()) == [("s", 19), ("u", 17)]


def test_placebo_takes_the_nearest_quiet_games(spark):
    week = timedelta(days=7)
    games = [(f"g{n}", T0 + n * week, "Chicago Bears @ Green Bay Packers") for n in range(-1, 5)] + [("pre", T0 - 8 * week, "Chicago Bears @ Green Bay Packers")]
    ev = spark.createDataFrame(games, "event_id string, starts_at timestamp, description string")
    mk = spark.createDataFrame([(f"L{n}", f"g{n}", "MONEY", "x MONEY") for n in range(-1, 5)] + [("P1", "g1", "YARDS", "Al Reed 3.5 YARDS"), ("Q1", "g1", "YARDS", "Bo Lind 3.5 YARDS")], "market_id string, event_id string, market_type string, description string")
    nw = spark.createDataFrame([(7, "Al Reed", "Bears", "g0", T0 - timedelta(hours=2), T0), (8, "No Team", None, "g0", T0, T0)], "post_id bigint, subject string, team string, event_id string, t0 timestamp, game_start timestamp")
    posts = spark.createDataFrame([(None, "Packers", T0 - week - timedelta(hours=2, minutes=30))], "subject string, team string, t0 timestamp")
    prior = spark.createDataFrame([("al reed", T0)], "name string, created timestamp")
    got, short = events.placebo_moments(nw, ev, mk, posts, prior, P, (T0 + 10 * week).replace(tzinfo=None))
    rows = {r["event_id"]: r for r in got.collect()}
    assert sorted(rows) == ["g1", "g2", "g3"]
    assert rows["g1"]["market_ids"] == ["P1", "L1"]
    assert rows["g1"]["at"] == (T0 + week - timedelta(hours=2)).replace(tzinfo=None) and rows["g1"]["tier1"]
    assert [(r["post_id"], r["shortfall"]) for r in short.collect()] == [(8, "team unknown")]


def test_summarize(spark):
    rows = [taker(-60, 0.45, 10), taker(5, 0.46, 2), maker(5, 0.54, 2), taker(1800, 0.65, 1)]
    r = measure.measure(moments(spark), spark.createDataFrame(rows, TRADES), ["post_id", "market_id"], P).withColumn("status", F.lit("out"))
    s = summary.summarize(r, ["status"], "xp", P).collect()[0]
    assert (s["events"], s["markets"], s["share_stale"], s["first_s_p50"], s["last_s_p90"], s["qty"]) == (1, 1, 1.0, 5.0, 5.0, 2.0)
    assert summary.summarize(r, ["status"], "t0", P).count() == 0


def test_study_of_a_moment_with_markets(spark):
    rows = [("news", 1, "Lou Hart", "Bears", "out", "g", True, at(0), at(7200), ["Lions", "Bears"], ["m", "t", "m"]), ("control_post", 2, "Ann Low", None, "active", "g", False, at(0), at(7200), ["Lions", "Bears"], ["m"])]
    moments_ = spark.createDataFrame(rows, "group string, post_id bigint, subject string, team string, status string, event_id string, tier1 boolean, at timestamp, game_start timestamp, game_teams array<string>, market_ids array<string>")
    markets = spark.createDataFrame([("m", "MONEY", "Detroit Lions @ Chicago Bears MONEY", [("yes", "DET Lions"), ("no", "CHI Bears")]), ("t", "TOTAL", "x TOTAL", [("yes", "Over 4"), ("no", "Under 4")])], "market_id string, market_type string, description string, outcomes array<struct<outcomeId:string,name:string>>")
    trades = spark.createDataFrame([taker(-60, 0.45, 10), taker(5, 0.46, 2), maker(5, 0.54, 2), taker(1800, 0.65, 1)], TRADES)
    got = study.run(moments_, markets, trades, P).collect()
    assert [(r["group"], r["market_id"], r["kind"], r["favored_id"], r["pregame"], r["week"], r["excluded"]) for r in got] == [("news", "m", "game_line", "yes", True, 4, None)]
    assert got[0]["move"] == pytest.approx(0.2) and got[0]["xp_fills"] == 1 and got[0]["t0_fills"] is None
    assert [tuple(r) for r in study.group_counts(study.run(moments_, markets, trades, P)).collect()] == [("news", True, None, 1, 1)]


def test_group_counts_need_no_fills(spark, monkeypatch):
    rows = [("news", 1, "Lou Hart", "Bears", "out", "g", True, at(0), at(7200), ["Lions", "Bears"], ["m"]), ("news", 3, "Lou Hart", "Bears", "out", "g", True, at(-9000), at(7200), ["Lions", "Bears"], ["m"])]
    moments_ = spark.createDataFrame(rows, "group string, post_id bigint, subject string, team string, status string, event_id string, tier1 boolean, at timestamp, game_start timestamp, game_teams array<string>, market_ids array<string>")
    markets = spark.createDataFrame([("m", "MONEY", "Detroit Lions @ Chicago Bears MONEY", [("yes", "DET Lions"), ("no", "CHI Bears")])], "market_id string, market_type string, description string, outcomes array<struct<outcomeId:string,name:string>>")
    trades = spark.createDataFrame([taker(-60, 0.45, 10), taker(5, 0.46, 2), maker(5, 0.54, 2), taker(1800, 0.65, 1)], TRADES)
    counts = lambda *views: sorted(map(str, study.group_counts(study.run(moments_, markets, trades, P, None, *views)).collect()))
    with_fills = counts()
    monkeypatch.setattr(measure, "with_stale_stats", None)
    assert counts(()) == with_fills and len(with_fills) == 2


def test_last_print_across_buckets_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    prints = [("m" if k % 3 else "n", "o", at(int(t)), float(k), 1.0) for k, t in enumerate(rng.choice(20_000, 150, replace=False))]
    asked = [(i, "m" if i % 2 else "n", "o", at(int(t))) for i, t in enumerate(rng.integers(-500, 21_000, 80))] + [(900, "m", "o", prints[1][2]), (901, None, "o", at(5)), (902, "m", "other", at(9000))]
    held = spark.createDataFrame(prints, "market_id string, outcome_id string, ts timestamp, cost double, qty double")
    for inclusive in (False, True):
        got = {r["id"]: (r["price"], r["price_ts"]) for r in asof.last_price(spark.createDataFrame(asked, "id bigint, market_id string, outcome_id string, at timestamp"), held, ["id"], 600, inclusive).collect()}
        assert len(got) == len(asked)
        for i, m, o, x in asked:
            seen = [(p[2], p[3]) for p in prints if p[0] == m and p[1] == o and x - timedelta(seconds=600) <= p[2] and (p[2] < x or (inclusive and p[2] == x))]
            assert got[i][0] == (max(seen)[1] if seen else None)


def test_interval_sums_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    prints = [("m" if rng.random() < 0.9 else "n", at(int(t)), 1, float(k)) for k, t in enumerate(rng.integers(0, 5000, 120))]
    asked = [(i, "m" if i % 3 else "n", at(int(t)), at(int(t) + int(w))) for i, (t, w) in enumerate(zip(rng.integers(-900, 6000, 90), rng.integers(0, 700, 90), strict=True))] + [(900, "x", at(0), at(9)), (901, None, at(0), at(9)), (902, "m", prints[0][1], prints[0][1])]
    df = spark.createDataFrame(asked, "id bigint, market_id string, lo timestamp, hi timestamp")
    got = {r["id"]: tuple(r)[1:] for r in asof.interval_sums(df, spark.createDataFrame(prints, "market_id string, ts timestamp, n int, qty double"), ["id"], ["market_id"], F.col("lo"), F.col("hi"), 700, ["n", "qty"]).collect()}
    want = {}
    for i, m, lo, hi in asked:
        seen = [p for p in prints if p[0] == m and lo <= p[1] <= hi]
        if seen:
            want[i] = (len(seen), pytest.approx(sum(p[3] for p in seen)), min(p[1] for p in seen).replace(tzinfo=None), max(p[1] for p in seen).replace(tzinfo=None))
    assert got == want and len(want) > 20


def test_a_price_does_not_depend_on_the_order_of_its_prints(spark):
    alike = [(0.1, 1, 1), (0.2, 1, 1), (0.3, 1, 1), (0.7, 3, 3)]  # price, size, number
    want = 0.0
    for cost in sorted(p * q for p, q, n in alike for _ in range(n)):
        want += cost
    for order in permutations(alike):
        rows = [taker(-60, p, q) for p, q, n in order for _ in range(n)]
        counted = [(at(-60), "m", "yes", "TAKER", p, float(n * q), n * (p * q), False, n, (p * q, float(q))) for p, q, n in order]
        for trades in (spark.createDataFrame(rows, TRADES).coalesce(1), spark.createDataFrame(counted, TRADES + ", n long, print struct<cost: double, qty: double>").coalesce(1)):
            assert [(r["cost"], r["qty"]) for r in asof.taker_prints(trades).collect()] == [(want, 12.0)]


def test_a_busy_market_is_many_buckets(spark):
    trades = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, "busy").otherwise(F.concat(F.lit("m"), F.col("id") % 7)).alias("market_id"), F.lit("o").alias("outcome_id"), F.lit("TAKER").alias("side"), (F.lit(T0.replace(tzinfo=None)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") / 7).cast("decimal(18,6)"))).alias("ts"), F.lit(1.0).alias("cost"), F.lit(2.0).alias("qty"))
    sizes = [r["count"] for r in asof.taker_prints(trades).withColumn("b", asof.bucket(F.col("ts"), 60)).groupBy("market_id", "b").count().collect()]
    assert len(sizes) > 300 and max(sizes) <= 60 * 7 + 1 and sum(sizes) == 20_000


def test_next_event_makes_no_pairs_and_agrees_with_all_pairs(spark):
    rng = np.random.default_rng(11)
    starts = [("a" if rng.random() < 0.8 else "b", int(k), at(int(t))) for k, t in enumerate(rng.integers(0, 4000, 60))] + [("a", 200, at(1000)), ("a", 201, at(1000)), (None, 300, at(1000))]
    asked = [(i, "a" if i % 3 else "b", at(int(t))) for i, t in enumerate(rng.integers(-900, 5000, 80))] + [(900, None, at(990)), (901, "x", at(990)), (902, "a", at(990)), (903, "a", at(990))]
    held, df = spark.createDataFrame(starts, "team string, event_id bigint, starts_at timestamp_ntz"), spark.createDataFrame(asked, "id bigint, team string, at timestamp_ntz")
    for before, after in ((-100, 500), (300, 200), (0, 0)):
        got = {r["id"]: (r["starts_at"], r["event_id"]) for r in asof.next_event(df, held, ["id"], ["team"], before, after).collect()}
        assert len(got) == len(asked)
        for i, team, x in asked:
            seen = [(s, e) for t, e, s in starts if t == team and team and x - timedelta(seconds=before) <= s <= x + timedelta(seconds=after)]
            want = min(seen) if seen else (None, None)
            assert got[i] == (want[0] and want[0].replace(tzinfo=None), want[1])
    # a thousand moments and a thousand starts of one time: two rows meet
    busy = spark.range(1000).select(F.col("id"), F.lit("a").alias("team"), F.lit(at(0).replace(tzinfo=None)).alias("at"))
    found = asof.next_event(busy, busy.select("team", F.col("id").alias("event_id"), F.col("at").alias("starts_at")), ["id"], ["team"], 60, 60)
    assert (found.count(), found.agg(F.max("event_id")).first()[0]) == (1000, 0)
    assert "_lo" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_equal_intervals_are_one_question_and_no_frame_looks_ahead(spark):
    asked = spark.range(300).select("id", F.lit("m").alias("market_id"), F.lit(at(0)).alias("at"))
    prints = spark.createDataFrame([("m", at(5 * k), 1) for k in range(40)], "market_id string, ts timestamp, n int")
    found = asof.interval_sums(asked, prints, ["id"], ["market_id"], F.col("at"), F.col("at") + F.expr("interval 100 seconds"), 100, ["n"])
    assert {tuple(r)[1:] for r in found.collect()} == {(21, at(0).replace(tzinfo=None), at(100).replace(tzinfo=None))} and found.count() == 300
    assert "unboundedfollowing$()))" not in found._jdf.queryExecution().optimizedPlan().toString().replace("unboundedpreceding$(), unboundedfollowing$()", "")


def test_fills_of_many_moments_against_all_pairs(spark):
    rng = np.random.default_rng(12)
    rows = [taker(int(t), 0.4 + 0.01 * int(k), 1 + int(k)) if rng.random() < 0.5 else maker(int(t), 0.6 - 0.01 * int(k), 1 + int(k)) for t, k in zip(rng.integers(0, 30, 150) * 60, rng.integers(0, 5, 150), strict=True)]
    takers = {}
    for r in rows:
        takers[r[0]] = takers.get(r[0], 0) + (r[3] == "TAKER")
    rows = [(*r[:7], takers[r[0]] > 1) for r in rows]
    favored = rows[0][2] if rows[0][3] == "TAKER" else next(r[2] for r in rows if r[3] == "TAKER")
    times = [at(60 * int(t)) for t in rng.integers(-5, 30, 60)]
    df = spark.createDataFrame([(i, rows[0][1], favored, t, 0.42 if i % 4 else None) for i, t in enumerate(times)], "post_id bigint, market_id string, favored_id string, at timestamp, thr double")
    trades = spark.createDataFrame(rows, TRADES)
    got = {r["post_id"]: r for r in measure.with_stale_stats(df, trades, {"x": "thr"}, P).collect()}
    sums = {r["post_id"]: r for r in measure.fill_totals(df, trades, ["post_id"], P).collect()}
    assert len(got) == 60 and 10 < len(sums) <= 60
    for i, t in enumerate(times):
        inside = [r for r in rows if t <= r[0] <= t + timedelta(seconds=P.window)]
        solo = {r[0] for r in inside if r[3] == "TAKER" and r[2] == favored and not r[7]}
        levels = [(r[0], 1.0 - r[4], r[5], False) for r in inside if r[3] == "MAKER" and r[2] != favored and r[0] in solo] + [(r[0], r[4], r[5], True) for r in inside if r[3] == "TAKER" and r[2] == favored and r[7]]
        if i % 4:
            stale = [x for x in levels if x[1] < 0.42]
            assert (got[i]["x_fills"], got[i]["x_qty_upper"], got[i]["x_ambiguous_qty"]) == (len(stale), sum(x[2] for x in stale), sum(x[2] for x in stale if x[3]))
            assert got[i]["x_first_s"] == (min((x[0] - t).total_seconds() for x in stale) if stale else None)
        else:
            assert got[i]["x_fills"] is None and got[i]["x_qty"] is None
        assert (i in sums) == bool(levels)
        if levels:
            assert (sums[i]["levels"], sums[i]["qty"], sums[i]["ambiguous"]) == (len(levels), sum(x[2] for x in levels), sum(x[3] for x in levels))
            assert sums[i]["cost"] == pytest.approx(sum(x[1] * x[2] for x in levels))
