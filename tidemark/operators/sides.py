"""Which outcome of a market news about a subject favours: names only, never prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import base_type, normalize_name, prop_player
from tidemark.functions.teams import starts_with_team

#: Statuses that void a player's own props before the game (fixed values).
VOIDING = ("out", "inactive", "ir")


def favored_side(rows: DataFrame) -> DataFrame:
    """Adds kind, favored_id, favored, reason to rows of subject, team, status, t0, game_start, game_teams, market_type, description, outcomes."""
    rows = rows.withColumn("_player", prop_player(F.col("description"), F.col("market_type")))
    same = normalize_name(F.coalesce("_player", F.lit(""))) == normalize_name(F.col("subject"))
    outcomes, n = F.col("outcomes"), F.size("outcomes")
    names = F.concat(F.lit("['"), F.array_join(F.transform(outcomes, lambda o: o["name"]), "', '"), F.lit("']"))
    rows = rows.withColumn("_same", same).withColumn("_opponent", F.get(F.filter("game_teams", lambda t: t != F.col("team")), F.lit(0)))
    under = F.filter(outcomes, lambda o: F.startswith(o["name"], F.lit("Under")))
    under_or_no = F.filter(outcomes, lambda o: F.startswith(o["name"], F.lit("Under")) | (o["name"] == "No"))
    hits = F.filter(outcomes, lambda o: starts_with_team(o["name"], F.col("_opponent")))
    base = base_type(F.col("market_type"))
    prop, pregame = F.col("_player").isNotNull(), F.col("t0") < F.col("game_start")

    def pick(kind: str, reason, chosen=None):
        chosen = F.lit(None).cast("struct<outcomeId:string,name:string>") if chosen is None else F.get(chosen, F.lit(0))
        return F.struct(F.lit(kind).alias("kind"), chosen["outcomeId"].alias("id"), chosen["name"].alias("name"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    count = F.concat(n.cast("string"), F.lit(" outcomes"))
    side = (
        F.when(prop & ~F.col("_same"), pick("player_prop", "another player's prop"))
        .when(prop & pregame & F.col("status").isin(*VOIDING), pick("player_prop", "player out pre-game; prop expected to void"))
        .when(prop & (n != 2), pick("player_prop", count))
        .when(prop & (F.size(under_or_no) > 0), pick("player_prop", "under / no", under_or_no))
        .when(prop, pick("player_prop", F.concat(F.lit("no under/no outcome in "), names)))
        .when(F.col("team").isNull(), pick("game_line", "subject's team unknown"))
        .when(base.isin("MONEY", "SPREAD") & (n != 2), pick("game_line", count))
        .when(base.isin("MONEY", "SPREAD") & (F.size(hits) == 1), pick("game_line", F.concat(F.lit("opponent "), "_opponent"), hits))
        .when(base.isin("MONEY", "SPREAD"), pick("game_line", F.concat(F.lit("cannot find "), "_opponent", F.lit(" in "), names)))
        .when((base == "TEAM_TOTAL") & ~starts_with_team(F.col("description"), F.col("team")), pick("team_total", "opponent's team total"))
        .when((base == "TEAM_TOTAL") & (F.size(under) == 1), pick("team_total", "subject's team total under", under))
        .when(base == "TEAM_TOTAL", pick("team_total", F.concat(F.lit("no under in "), names)))
        .otherwise(pick("game_line", F.concat(F.lit("no clear side for "), "market_type")))
    )
    rows = rows.withColumn("_side", side)
    return rows.withColumns({"kind": F.col("_side.kind"), "favored_id": F.col("_side.id"), "favored": F.col("_side.name"), "reason": F.col("_side.reason")}).drop("_side", "_player", "_same", "_opponent")
