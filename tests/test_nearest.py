"""Nearest candidates in time by number, against all pairs."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import events, ordered
from tidemark.plans.params import Params

T0 = datetime(2026, 10, 4)


@pytest.fixture(params=["window", "ranges"])
def way(request, monkeypatch):
    """Both ways of running sums: in one window, and by ranges."""
    if request.param == "ranges":
        monkeypatch.setattr(ordered, "SMALL", -1)


@pytest.mark.parametrize(("seed", "rejects"), [(2, 0.5), (3, 0.97)])
def test_random_candidates(spark, way, seed, rejects):
    rng = random.Random(seed)
    at = lambda k: T0 + timedelta(hours=k)
    span = rng.choice([10, 60])
    targets = [(i, rng.choice("aab"), at(rng.randrange(-3, span + 3))) for i in range(50)] + [(90, "none", at(1)), (91, None, at(1))]
    held = [(rng.choice("aaac"), k, at(rng.randrange(span))) for k in range(150)] + [("b", 1000, at(5))]
    bad = {(i, k) for i, *_ in targets for _, k, _ in held if rng.random() < rejects}
    out = spark.createDataFrame([*bad, (-1, -1)], "id int, other int")
    accept = lambda pairs: pairs.join(out, ["id", "other"], "left_anti")
    got = events.nearest_in_time(spark.createDataFrame(targets, "id int, who string, at timestamp_ntz"), spark.createDataFrame(held, "who string, other int, t timestamp_ntz"), ["id"], ["who"], "at", "t", "other", 3, accept)
    want = []
    for i, who, t in targets:
        best = sorted((abs((x - t).total_seconds()), k) for w, k, x in held if w == who and (i, k) not in bad)[:3]
        want += [(i, k, n + 1) for n, (_, k) in enumerate(best)]
    assert got.columns == ["id", "who", "at", "other", "t", "nth"] or set(got.columns) == {"id", "who", "at", "other", "t", "nth"}
    assert sorted((r["id"], r["other"], r["nth"]) for r in got.collect()) == sorted(want)


def test_no_pair_of_a_subject_meets_in_full(spark, monkeypatch):
    seen = []
    targets = spark.range(400).selectExpr("id", "'s' as who", "timestamp_ntz '2026-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as at")
    held = targets.selectExpr("who", "id as other", "at as t")
    was = events.written
    monkeypatch.setattr(events, "written", lambda df, tag: (lambda t: (seen.append(t.count()) if tag == "pairs" else None, t)[1])(was(df, tag)))
    got = events.nearest_in_time(targets, held, ["id"], ["who"], "at", "t", "other", 2, lambda p: p.filter("id <> other"))
    assert got.count() == 800 and sum(seen) <= 400 * 16  # not 400 * 400


def test_nothing_to_look_for(spark):
    t = spark.createDataFrame([], "id int, who string, at timestamp_ntz")
    c = spark.createDataFrame([("a", 1, T0)], "who string, other int, t timestamp_ntz")
    assert events.nearest_in_time(t, c, ["id"], ["who"], "at", "t", "other", 3).count() == 0
    one = spark.createDataFrame([(1, "a", T0)], "id int, who string, at timestamp_ntz")
    assert events.nearest_in_time(one, c.limit(0), ["id"], ["who"], "at", "t", "other", 3).count() == 0


def test_games_near_talk_meet_no_post(spark, monkeypatch):
    """Where something is said about a subject before nearly all games, its news are not looked up against these."""
    day, n = timedelta(days=1), 60
    ev = spark.createDataFrame([(f"g{k:02}", T0 + k * day, "Chicago Bears @ Green Bay Packers") for k in range(n)], "event_id string, starts_at timestamp_ntz, description string")
    mk = ev.selectExpr("concat('L', event_id) as market_id", "event_id", "'MONEY' as market_type", "'x MONEY' as description")
    nw = spark.createDataFrame([(k, "Al Reed", "Bears", f"g{k:02}", T0 + k * day - timedelta(hours=2), T0 + k * day) for k in range(n)], "post_id bigint, subject string, team string, event_id string, t0 timestamp_ntz, game_start timestamp_ntz")
    said = spark.createDataFrame([("Al Reed", None, T0 + k * day - timedelta(hours=2)) for k in range(n) if k not in (3, 40, 41)], "subject string, team string, t0 timestamp_ntz")
    seen, was = [], events.written
    monkeypatch.setattr(events, "written", lambda df, tag: (lambda t: (seen.append(t.count()) if tag == "pairs" else None, t)[1])(was(df, tag)))
    prior = spark.createDataFrame([], "name string, created timestamp_ntz")
    got, short = events.placebo_moments(nw, ev, mk, said, prior, Params(), T0 + 90 * day)
    want = [(p, k) for p in range(n) for k in (3, 40, 41) if k != p]
    assert sorted((r["post_id"], int(r["event_id"][1:])) for r in got.collect()) == want
    assert sorted(r["post_id"] for r in short.collect()) == [3, 40, 41]
    assert sum(seen) <= n * 3  # not n * n


def test_what_is_looked_up_is_not_broadcast(spark, monkeypatch):
    plans, was = [], events.written
    monkeypatch.setattr(events, "written", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().sparkPlan().toString())), was(df, tag))[1])
    targets = spark.range(20).selectExpr("id", "'s' as who", "timestamp_ntz '2026-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as at")
    events.nearest_in_time(targets, targets.selectExpr("who", "id as other", "at as t"), ["id"], ["who"], "at", "t", "other", 2, lambda p: p.filter("id <> other")).count()
    assert not [tag for tag, plan in plans if tag in ("candidates", "pairs", "nearest") and "BroadcastHashJoin" in plan]
