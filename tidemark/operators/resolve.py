"""Resolution of classified subjects to teams, games and markets, as of the post's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import is_game_line, normalize_name, prop_player, uuid7_time
from tidemark.functions.teams import game_teams, team_of_abbreviation
from tidemark.operators.asof import next_event
from tidemark.plans.params import Params


def recent_team(games: Column) -> Column:
    """Teams that fit the games (arrays of teams, newest first): narrowed game by game until one is left or a game shares none; what is settled stays settled."""
    empty = F.struct(F.get(games, F.lit(0)).alias("teams"), F.lit(False).alias("done"))

    def fold(acc, teams):
        common = F.array_intersect(acc["teams"], teams)
        stop = acc["done"] | (F.size(acc["teams"]) == 1) | (F.size(common) == 0)
        return F.when(stop, F.struct(acc["teams"].alias("teams"), F.lit(True).alias("done"))).otherwise(F.struct(common.alias("teams"), F.lit(False).alias("done")))

    return F.when(F.size(games) > 0, F.aggregate(F.slice(games, F.lit(2), F.greatest(F.size(games) - 1, F.lit(0))), empty, fold, lambda acc: acc["teams"]))


def roster_teams(roster: DataFrame) -> DataFrame:
    """name, teams from rows of a parsed roster map column `players`."""
    each = roster.select(F.explode(F.map_values("players")).alias("p"))
    return each.select(normalize_name(F.col("p.full_name")).alias("name"), team_of_abbreviation(F.col("p.team")).alias("team")).filter("name <> '' and team is not null").groupBy("name").agg(F.sort_array(F.collect_set("team")).alias("teams"))


def prop_rows(markets: DataFrame) -> DataFrame:
    """market_id, event_id, name, created of the player props among markets."""
    player = prop_player(F.col("description"), F.col("market_type"))
    return markets.withColumn("_p", player).filter("_p is not null").select("market_id", "event_id", normalize_name(F.col("_p")).alias("name"), uuid7_time(F.col("market_id")).alias("created"))


def resolve(posts: DataFrame, events: DataFrame, markets: DataFrame, p: Params, roster: DataFrame | None = None, version: str = "rules") -> DataFrame:
    """One row for each subject of posts (post_id, t0, players, team): status, reason, event_id, team, tier1, market_ids.

    events: event_id, starts_at, description; markets: market_id, event_id, market_type, description; roster: name, teams.
    """
    games = events.withColumn("teams", game_teams(F.col("description"))).filter("teams is not null").select("event_id", "starts_at", "teams")
    in_games = markets.join(games.select("event_id"), "event_id", "left_semi")
    props, lines = prop_rows(in_games), in_games.filter(is_game_line(F.col("market_type"))).select("market_id", "event_id")
    s = posts.select("post_id", "t0", F.col("team").alias("post_team"), F.posexplode("players").alias("nth", "subject")).withColumn("name", normalize_name(F.col("subject")))
    id_ = ["post_id", "nth"]
    # props that existed before the post, by game, newest game first
    before = s.join(props, "name").filter(F.col("created") < F.col("t0"))
    history = before.select(*id_, "event_id").distinct().join(games, "event_id").groupBy(*id_).agg(F.transform(F.sort_array(F.collect_list(F.struct("starts_at", "event_id", "teams")), asc=False), lambda g: g["teams"]).alias("games"))
    s = s.join(history, id_, "left").withColumn("history", F.array_sort(recent_team(F.coalesce("games", F.array().cast("array<array<string>>"))))).withColumn("tier1", F.col("games").isNotNull())
    s = s.join(roster if roster is not None else s.sparkSession.createDataFrame([], "name string, teams array<string>"), "name", "left").withColumn("known", F.array_intersect(F.coalesce("teams", F.array().cast("array<string>")), F.coalesce("history", F.array().cast("array<string>")))).drop("teams")
    quoted = F.concat(F.lit("['"), F.array_join("history", "', '"), F.lit("']"))
    clash = F.col("post_team").isNotNull() & F.col("history").isNotNull() & ~F.array_contains("history", F.col("post_team"))
    nil = F.lit(None).cast("string")

    def say(status, why, team):
        return F.struct(status.alias("status"), why.alias("why"), team.alias("team"))

    verdict = (
        F.when(clash, say(F.lit("ambiguous"), F.concat(F.lit("post says "), "post_team", F.lit("; props before t0 were in games of "), quoted), nil))
        .when(F.col("post_team").isNotNull(), say(nil, F.lit("team from post"), F.col("post_team")))
        .when(F.col("history").isNull(), say(F.lit("unmatched"), F.lit("no team: post names none, no props before t0"), nil))
        .when(F.size("history") == 1, say(nil, F.lit("team from prop history"), F.get("history", F.lit(0))))
        .when(F.size("known") == 1, say(nil, F.lit("team from roster tie-break"), F.get("known", F.lit(0))))
        .otherwise(say(F.lit("ambiguous"), F.concat(F.lit("team unclear among "), quoted), nil))
    )
    s = s.withColumn("v", verdict).withColumn("team", F.col("v.team"))
    going = next_event(s.filter("team is not null").select(*id_, "team", F.col("t0").alias("at")), games.select("event_id", "starts_at", F.explode("teams").alias("team")), id_, ["team"], p.game_length, p.after)
    s = s.join(going.select(*id_, "event_id"), id_, "left")
    mine = before.select(*id_, "market_id", "event_id", "created").join(s.select(*id_, "event_id"), [*id_, "event_id"]).groupBy(*id_).agg(F.transform(F.sort_array(F.collect_list(F.struct("created", "market_id"))), lambda x: x["market_id"]).alias("props"))
    others = lines.groupBy("event_id").agg(F.sort_array(F.collect_list("market_id")).alias("lines"))
    s = s.join(mine, id_, "left").join(others, "event_id", "left")
    none = F.array().cast("array<string>")
    ids = F.concat(F.coalesce("props", none), F.coalesce("lines", none))
    placed = F.col("event_id").isNotNull()
    status = F.when(F.col("v.status").isNotNull(), F.col("v.status")).when(~placed, "unmatched").when(F.col("props").isNotNull(), "matched").otherwise("team_only")
    reason = F.when(F.col("v.status").isNotNull() | F.col("props").isNotNull(), F.col("v.why")).when(~placed, F.concat(F.lit("no "), "team", F.lit(" game in progress or within 8 days"))).otherwise(F.concat(F.col("v.why"), F.lit("; no props for player in this game")))
    return s.select("post_id", F.lit(version).alias("model_version"), "subject", status.alias("status"), reason.alias("reason"), "event_id", "team", "tier1", F.when(placed & (F.size(ids) > 0), ids).alias("market_ids"), F.current_timestamp().alias("resolved_at"))


def traded_only(resolutions: DataFrame, traded: DataFrame) -> DataFrame:
    """Market lists without the markets that never traded, in their order; an empty list is NULL."""
    each = resolutions.select("post_id", "model_version", "subject", F.posexplode("market_ids").alias("pos", "market_id")).join(traded.select("market_id").distinct(), "market_id", "left_semi")
    kept = each.groupBy("post_id", "model_version", "subject").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "market_id"))), lambda x: x["market_id"]).alias("market_ids"))
    return resolutions.drop("market_ids").join(kept, ["post_id", "model_version", "subject"], "left").select(*resolutions.columns)
