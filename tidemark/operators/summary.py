"""Summaries of measured markets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import group_quantiles, join_groups
from tidemark.plans.params import Params
from tidemark.scratch import written


def summarize(rows: DataFrame, by: list[str], view: str, p: Params) -> DataFrame:
    """Per group over the markets that the view measured: events, markets, share with stale fills, timing quantiles (nearest rank), stale size."""
    v = view
    total = lambda c: F.bround(F.coalesce(F.sum(f"{v}_{c}"), F.lit(0.0)), 0)
    used = rows.filter(F.col(f"{v}_fills").isNotNull())
    used = written(used.select(*{c: None for c in [*by, "post_id"]}, *[c for c in rows.columns if c.startswith(f"{v}_") and c not in by]), "summarized")
    sums = used.groupBy(*by).agg(
        F.count_distinct("post_id").alias("events"),
        F.count("*").alias("markets"),
        F.bround(F.avg((F.col(f"{v}_fills") > 0).cast("double")), 3).alias("share_stale"),
        total("qty").alias("qty"),
        total("cost").alias("cost_usd"),
        total("ambiguous_qty").alias("ambiguous_qty"),
        total("qty_upper").alias("qty_upper"),
        *(total(f"qty_{b}").alias(f"qty_{b}") for b, _, _ in p.buckets),
    )
    timing = {f"{c}_p{round(100 * q)}": (f"{v}_{c}", None if q == 0.5 else q) for c, q in (("first_s", 0.5), ("first_s", 0.9), ("last_s", 0.25), ("last_s", 0.5), ("last_s", 0.75), ("last_s", 0.9))}
    got = join_groups(sums, group_quantiles(used, by, timing), by)
    sizes = [c for c in sums.columns if c not in [*by, "events", "markets", "share_stale"]]
    return got.select(*by, "events", "markets", "share_stale", *[F.bround(c, 1).alias(c) for c in timing], *sizes)


def drift_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of a move that came before the news: ratio of sums, median share, and how often it was half or more."""
    moved = rows.filter("moved and drift is not null").withColumn("share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("drift") / (F.col("drift") + F.col("move"))))).filter("drift + move > 0")
    moved = written(moved.select(*by, "drift", "move", "share"), "moved")
    sums = moved.groupBy(*by).agg(F.count("*").alias("markets"), F.round(F.sum("drift") / F.sum(F.col("drift") + F.col("move")), 3).alias("ratio"), F.round(F.avg((F.col("share") >= 0.5).cast("double")), 3).alias("half_or_more"))
    got = join_groups(sums, group_quantiles(moved, by, {"median_share": ("share", None)}), by)
    return got.select(*by, "markets", "ratio", F.round("median_share", 3).alias("median_share"), "half_or_more")


def per_event(rows: DataFrame, by: list[str], view: str = "xp") -> DataFrame:
    """Roll-up of the markets of an event."""
    v = view
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("markets"), F.count_if("moved").alias("moved"), F.count_if(F.col(f"{v}_fills") > 0).alias("with_stale"), F.bool_or(F.coalesce(F.col(f"{v}_fills") > 0, F.lit(False))).alias("any_stale"),
        F.min(f"{v}_first_s").alias("first_s"), F.max(f"{v}_last_s").alias("last_s"), zero(f"{v}_qty").alias("qty"), zero(f"{v}_cost").alias("cost"), F.sum(f"{v}_qty_upper").alias("qty_upper"),
    )


def largest_events(events: DataFrame, key: str, n: int = 40) -> DataFrame:
    return events.orderBy(F.desc_nulls_last("qty_upper"), key).limit(n)
