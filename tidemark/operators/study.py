"""The event study end to end: moments with their markets, favoured sides, expected moves, measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import season_week
from tidemark.operators import fit, measure, sides
from tidemark.plans.params import Params
from tidemark.scratch import written

#: The groups of moments, and what identifies a moment's row for one market.
NEWS, CONTROL, PLACEBO = "news", "control_post", "placebo"
ID = ["moment_id", "market_id"]


def market_moments(moments: DataFrame, markets: DataFrame, p: Params) -> DataFrame:
    """A row for each market of each moment that has a favoured side, with its kind, whether it is before the game, and the week.

    moments: group, post_id, subject, team, status, event_id, tier1, at, game_start, game_teams, market_ids; markets: market_id, market_type,
    description, outcomes.  The side is that of news at the moment itself.
    """
    named = moments.withColumn("moment_id", F.concat_ws("|", "group", "post_id", "subject", "event_id"))
    each = named.withColumn("market_id", F.explode(F.array_distinct("market_ids"))).drop("market_ids").join(markets, "market_id").withColumn("t0", F.col("at"))
    sided = sides.favored_side(each).filter("favored_id is not null")
    sided = sided.withColumns({"pregame": F.col("at") < F.col("game_start"), "week": season_week(F.col("game_start"), p.season_start, p.season_zone)})
    return sided.select("moment_id", "group", "post_id", "status", "subject", "tier1", "event_id", "at", "game_start", "pregame", "week", "market_id", "market_type", "kind", "favored_id", "favored")


def measure_moments(moments: DataFrame, markets: DataFrame, trades: DataFrame, p: Params, data_end=None, views: tuple[str, ...] = ("xp", "t0")) -> DataFrame:
    """Measurements of all markets of all moments, without expected moves."""
    rows = market_moments(moments, markets, p).withColumn("expected_move", F.lit(None).cast("double"))
    return measure.measure(rows, trades, ID, p, data_end, views)


def run(moments: DataFrame, markets: DataFrame, trades: DataFrame, p: Params, data_end=None, views: tuple[str, ...] = ("xp", "t0")) -> DataFrame:
    """The whole study: news teach the expected moves, each by what had settled before; then every group is measured with them.

    Prices don't depend on what was expected, so they are looked up once for all groups and written; from that table come
    the lessons, the expected moves and the statistics of fills in the views asked for; these add columns only, no rows.
    """
    rows = written(measure.prices(market_moments(moments, markets, p), trades, p, data_end), "prices")
    taught = fit.fit_rows(rows.filter(F.col("group") == NEWS), p)
    control = F.col("group") == CONTROL
    expected = fit.expected_moves(rows.filter(~control), taught, ID, p).unionByName(fit.expected_moves(rows.filter(control), taught, ID, p, control=True))
    return measure.stale_views(expected, trades, p, views)


def group_counts(measured: DataFrame) -> DataFrame:
    """Events and markets by group, game phase and exclusion."""
    return measured.groupBy("group", "pregame", "excluded").agg(F.count_distinct("post_id").alias("events"), F.count("*").alias("markets"))
