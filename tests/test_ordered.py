"""Running sums in a global order, and expanding medians in blocks."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fit, ordered
from tidemark.plans.params import Params

T0 = datetime(2026, 10, 4, 17, 0)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_sums_over_many_tasks(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None, f"k{rng.randrange(9)}"]), k % 2, rng.randrange(50), rng.randrange(4)) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, odd int, at int, w int")
    got = [tuple(r) for r in ordered.running(df, ["key", "odd"], ["at"], "before", F.col("w"), parts).collect()]
    assert sorted((r[:4] for r in got), key=str) == sorted(rows, key=str)
    for key in {r[:2] for r in rows}:
        total = 0
        for _, _, _, w, before in sorted((r for r in got if r[:2] == key), key=lambda r: (r[4], r[3] > 0, r[2])):
            assert before == total  # rows without weight share their place with the next one
            total += w
        for _, _, at, w, before in (r for r in got if r[:2] == key):
            less, same = (sum(x[3] for x in rows if x[:2] == key and ok(x[2])) for ok in (lambda x: x < at, lambda x: x == at))  # noqa: B023
            assert less <= before <= less + same - w
    places = [r[:2] + (r[4],) for r in map(tuple, ordered.running(df, ["key", "odd"], ["at"], "n", None, parts).collect())]
    assert len(set(places)) == len(rows)


def test_running_sums_of_nothing(spark):
    df = spark.createDataFrame([], "key string, at int")
    assert ordered.running(df, ["key"], ["at"], "n").count() == 0


def brute(rows, at, least):
    known = [(m, p) for s, m, p in rows if s < at]
    return statistics.median(m for m, _ in known) if len({p for _, p in known}) >= least else None


@pytest.fixture(params=["window", "ranges"])
def way(request, monkeypatch):
    """Both ways of running sums: in one window, and by ranges."""
    if request.param == "ranges":
        monkeypatch.setattr(ordered, "SMALL", -1)


@pytest.mark.parametrize(("seed", "block", "n"), [(1, 1, 60), (3, 16, 700), (4, 4096, 200)])
def test_expanding_medians_in_blocks(spark, way, seed, block, n, monkeypatch):
    monkeypatch.setattr(fit, "SHARED", 2)
    rng = random.Random(seed)
    at = lambda k: T0 + timedelta(minutes=k)
    values = [lambda: rng.gauss(0, 1), lambda: float(rng.randrange(3)), lambda: rng.random() ** 9]
    rows = [(g, at(rng.randrange(n)), v(), rng.randrange(40)) for g, v, size in (("x", values[0], n), ("y", values[1], n // 2), ("z", values[2], 7)) for _ in range(size)]
    rows += [("x", at(n // 2), 5.0 + k, 99) for k in range(block + 5)]  # many at one time
    targets = [(k, rng.choice("xyzw"), at(rng.randrange(-2, n + 9))) for k in range(150)] + [(200, "x", at(n * 9)), (201, "x", at(n // 2)), (202, "x", at(n // 2 + 1))]
    monkeypatch.setattr(fit.math, "isqrt", lambda _: block)
    got = fit.expanding_medians(spark.createDataFrame(targets, "id int, _g string, at timestamp_ntz"), spark.createDataFrame(rows, "_g string, settled_at timestamp_ntz, move double, post_id int"), ["id"], 5, block).collect()
    want = {(k, g): brute([r[1:] for r in rows if r[0] == g], t, 5) for k, g, t in targets}
    assert {(r["id"], r["_g"]): r["median"] for r in got} == {k: pytest.approx(v) for k, v in want.items() if v is not None}
    assert len(got) > 60


def test_one_status_is_spread_over_tasks(spark):
    n = 3000
    rows = spark.range(n).select(F.lit("{}").alias("_g"), (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("settled_at"), F.rand(1).alias("move"), "id").withColumnRenamed("id", "post_id")
    targets = rows.select(F.col("post_id").alias("id"), "_g", F.col("settled_at").alias("at"))
    medians = fit.expanding_medians(targets, rows, ["id"], 5, 64)
    sizes = {r["id"] for r in medians.select("id").collect()}
    assert sizes == set(range(5, n))
    asked = targets.select("_g", F.col("id").alias("n")).withColumn("block", F.floor(F.col("n") / 64))
    held = rows.select("_g", F.col("post_id").alias("s"), "move").withColumn("r", F.row_number().over(fit.Window.partitionBy("_g").orderBy("move")).cast("long") - 1)
    blocks = [r["count"] for r in fit._middles(held, asked, 64).groupBy("block").count().collect()]
    assert len(blocks) == (n - 1) // 64 and max(blocks) <= 4 * 64 + 8  # never a whole prefix


def test_rungs_are_groups_of_one_pass(spark):
    rows = [(n, "m", "out", "game_line", True, T0 - timedelta(days=10 - n), 3, 0.1 * n, None, False) for n in range(6)]
    schema = "post_id bigint, market_id string, status string, kind string, tier1 boolean, at timestamp_ntz, week int, move double, excluded string, post_cut_short boolean"
    known = fit.fit_rows(spark.createDataFrame(rows, schema), Params())
    asked = spark.createDataFrame([(50, "m", "out", "game_line", True, T0, 2, None, None, None), (51, "m", "out", "game_line", None, T0, 2, None, None, None), (52, "m", None, None, None, T0, 2, None, None, None)], schema)
    got = {r["post_id"]: r["expected_move"] for r in fit.expected_moves(asked, known, ["post_id"], Params()).collect()}
    assert got == {50: pytest.approx(0.25), 51: pytest.approx(0.25), 52: None}


def test_group_quantiles_against_the_definition(spark):
    from tidemark.operators.quantiles import group_quantiles

    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "c"]), rng.choice([None, float(rng.randrange(9)), rng.random()]), rng.choice([None, 1.0, 2.0])) for _ in range(300)] + [("only", None, 4.0), ("none", None, None)]
    wanted = {"m": ("x", None), "q9": ("x", 0.9), "q25": ("x", 0.25), "ym": ("y", None), "y0": ("y", 0.0)}
    got = {r["g"]: r.asDict() for r in group_quantiles(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], wanted).collect()}
    assert set(got) == {"a", None, "c", "only"}
    for g, r in got.items():
        for name, (c, q) in wanted.items():
            v = sorted(x[1 if c == "x" else 2] for x in rows if x[0] == g and x[1 if c == "x" else 2] is not None)
            assert r[name] == (None if not v else pytest.approx(statistics.median(v) if q is None else v[round(q * (len(v) - 1))]))


def test_quantiles_keep_no_lists(spark):
    import contextlib
    import io

    from tidemark.operators.quantiles import group_quantiles

    df = group_quantiles(spark.range(50).select((F.col("id") % 2).alias("g"), F.col("id").alias("x")), ["g"], {"m": ("x", None)})
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    assert "collect_list" not in out.getvalue() and "percentile" not in out.getvalue()
