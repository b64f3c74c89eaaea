"""Canonical views of the driver's tables: prints, news and schedules for the operators to run on, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ingest import flag_ambiguous


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as prints: 25 markets (brands), two outcomes (line status), takers are returned lines."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    price = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_shipdate").alias("ts"), F.col("p_brand").alias("market_id"), F.col("l_linestatus").alias("outcome_id"), F.when(F.col("l_returnflag") == "R", "TAKER").otherwise("MAKER").alias("side"), F.col("l_quantity").alias("qty"), price.alias("price"), (price * F.col("l_quantity")).alias("cost"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_ambiguous(raw_prints(spark, sf_dir))


def counted_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same prints, those alike as one row: their number n, the sums of their quantities and costs, and the cost and quantity of each."""
    alike = raw_prints(spark, sf_dir).groupBy("ts", "market_id", "outcome_id", "side", "price", "qty", "cost").agg(F.count("*").alias("n"))
    n, each = F.col("n"), F.struct("cost", "qty").alias("print")
    return flag_ambiguous(alike.select("ts", "market_id", "outcome_id", "side", "price", "n", (n * F.col("qty")).alias("qty"), (n * F.col("cost")).alias("cost"), each))


def news_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as news, each with the markets (brands) of its lines and a favoured outcome."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    key = F.col("o_orderkey")
    start = F.when(key % 3 == 0, F.col("o_orderdate") - F.expr("interval 20 days")).otherwise(F.col("o_orderdate") + F.expr("interval 5 days"))
    return rows.select(key.alias("post_id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("subject"), F.col("p_brand").alias("market_id"), F.when(key % 2 == 0, "O").otherwise("F").alias("favored_id"), start.alias("game_start"), (key % 2 == 0).alias("tier1")).distinct()


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as news about the customer's nation."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("post_id"), F.col("o_orderdate").alias("t0"), F.col("o_custkey").alias("subject"), F.col("c_nationkey").alias("event_id"), F.col("o_orderpriority").alias("status"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same urgent orders as moments of a study, each with all its markets in one list: half of them about the home team, orders in process as control posts."""
    n = news_markets(spark, sf_dir)
    each = n.groupBy("post_id", "at", "status", "subject", "favored_id", "game_start", "tier1").agg(F.flatten(F.collect_list(F.array("market_id", F.concat("market_id", F.lit(" total"))))).alias("market_ids"))
    group, team = F.when(F.col("status") == "P", "control_post").otherwise("news"), F.when(F.col("favored_id") == "O", "Bears").otherwise("Lions")
    return each.select(group.alias("group"), "post_id", F.col("subject").cast("string").alias("subject"), team.alias("team"), "status", F.col("post_id").cast("string").alias("event_id"), "tier1", "at", "game_start", F.array(F.lit("Lions"), F.lit("Bears")).alias("game_teams"), "market_ids")


def _outcomes(*named: tuple[str, str]):
    return F.array(*[F.struct(F.lit(i).alias("outcomeId"), F.lit(n).alias("name")) for i, n in named])


def side_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand as a market between two teams whose outcomes are its prints', and as a total that favours nobody."""
    brand = table(spark, sf_dir, "part").select(F.col("p_brand").alias("market_id")).filter("market_id is not null").distinct()
    money = brand.select("market_id", F.lit("MONEY").alias("market_type"), F.lit("Detroit Lions @ Chicago Bears MONEY").alias("description"), _outcomes(("O", "DET Lions"), ("F", "CHI Bears")).alias("outcomes"))
    total = brand.select(F.concat("market_id", F.lit(" total")), F.lit("TOTAL"), F.lit("Detroit Lions @ Chicago Bears TOTAL"), _outcomes(("O", "Over 44.5"), ("F", "Under 44.5")))
    return money.union(total)


def part_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as markets of all kinds with news about a player of the home team, who may be out, unnamed or late."""
    i = F.col("p_partkey")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (i % len(x) + 1).cast("int"))
    kind = pick("MONEY", "SPREAD_1H", "TOTAL", "TEAM_TOTAL", "YARDS", "YARDS")
    own = F.when(i % 13 == 0, "DET Lions").otherwise("CHI Bears")
    head = F.when(kind.isin("MONEY", "SPREAD_1H", "TOTAL"), "Detroit Lions @ Chicago Bears").when(kind == "TEAM_TOTAL", F.concat(own, F.lit(" 20.5"))).when(i % 6 == 4, "Lóu Hart Jr. 55.5").otherwise("Dan Wolf 40.5")
    outcomes = F.when(kind.isin("MONEY", "SPREAD_1H"), _outcomes(("a", "DET Lions"), ("b", "CHI Bears"))).otherwise(_outcomes(("a", "Over 1.5"), ("b", "Under 1.5")))
    third = F.when((i % 11 == 0) & (kind != "TEAM_TOTAL"), F.array_append(outcomes, F.struct(F.lit("c").alias("outcomeId"), F.lit("Draw").alias("name")))).otherwise(outcomes)
    at = F.lit("2026-10-04 17:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "part").select(i.cast("string").alias("market_id"), kind.alias("market_type"), F.concat_ws(" ", head, kind).alias("description"), third.alias("outcomes"), F.lit("Lou Hart").alias("subject"), F.when(i % 7 != 0, "Bears").alias("team"), F.when(i % 2 == 0, "out").otherwise("doubtful").alias("status"), F.when(i % 3 > 0, at - F.expr("interval 2 hours")).otherwise(at + F.expr("interval 2 hours")).alias("t0"), at.alias("game_start"), F.array(F.lit("Lions"), F.lit("Bears")).alias("game_teams"))


PRINTS = """
raw AS (SELECT l_shipdate AS ts, p_brand AS market_id, l_linestatus AS outcome_id, CASE WHEN l_returnflag = 'R' THEN 'TAKER' ELSE 'MAKER' END AS side,
    l_quantity AS qty, l_discount * 10 AS price, l_discount * 10 * l_quantity AS cost FROM lineitem JOIN part ON l_partkey = p_partkey),
prints AS (SELECT *, sum(CASE WHEN side = 'TAKER' THEN 1 ELSE 0 END) OVER (PARTITION BY ts, market_id) AS taker_count FROM raw),
takers AS (SELECT market_id, outcome_id, ts, sum(cost) AS c, sum(qty) AS q FROM prints WHERE side = 'TAKER' GROUP BY ALL)"""

NEWS_MARKETS = """
n AS (SELECT DISTINCT o_orderkey AS post_id, o_orderdate AS moment, o_orderstatus AS status, o_custkey AS subject, p_brand AS market_id, CASE WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'F' END AS favored_id,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 20 DAY ELSE o_orderdate + INTERVAL 5 DAY END AS game_start, o_orderkey % 2 = 0 AS tier1
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT')"""

NEWS = "news AS (SELECT o_orderkey AS post_id, o_orderdate AS t0, o_custkey AS subject, c_nationkey AS event_id, o_orderpriority AS status FROM orders JOIN customer ON o_custkey = c_custkey)"


def last(name: str, low: str, high: str) -> str:
    """The last group of takers of a news market within two bounds on t.ts."""
    return f"""{name} AS (SELECT * FROM (SELECT n.post_id, n.market_id, t.ts, t.c / t.q AS price, row_number() OVER (PARTITION BY n.post_id, n.market_id ORDER BY t.ts DESC) AS rn
    FROM n JOIN takers AS t ON n.market_id = t.market_id AND n.favored_id = t.outcome_id AND {low} AND {high}) AS _x WHERE rn = 1)"""


FILLS = """
w AS (SELECT n.post_id, n.market_id, n.favored_id, n.moment, p.* EXCLUDE (market_id), max(p.side = 'TAKER' AND p.outcome_id = n.favored_id AND p.taker_count <= 1) OVER (PARTITION BY n.post_id, n.market_id, p.ts) AS swept
    FROM n JOIN prints AS p ON n.market_id = p.market_id AND p.ts >= n.moment AND p.ts <= n.moment + INTERVAL 10 DAY),
lv AS (SELECT post_id, market_id, moment, ts, 1.0 - price AS price, qty, false AS ambiguous FROM w WHERE side = 'MAKER' AND outcome_id <> favored_id AND swept
    UNION ALL SELECT post_id, market_id, moment, ts, price, qty, true FROM w WHERE side = 'TAKER' AND outcome_id = favored_id AND taker_count > 1)"""

MEASURE = f"""
g AS (SELECT *, moment + INTERVAL 60 DAY AS full_end, CASE WHEN moment >= game_start THEN least(moment + INTERVAL 60 DAY, game_start + INTERVAL 90 DAY) ELSE moment + INTERVAL 60 DAY END AS s_end FROM n),
e AS (SELECT *, CASE WHEN full_end > TIMESTAMP '1998-06-01' THEN 'trade data ends inside the settle window'
    WHEN moment >= game_start AND s_end <= moment + INTERVAL 10 DAY THEN 'game ends before the post-news window' END AS early FROM g),
{last("pre", "t.ts >= n.moment - INTERVAL 60 DAY", "t.ts < n.moment")},
{last("lead_", "t.ts >= n.moment - INTERVAL 70 DAY", "t.ts <= n.moment - INTERVAL 10 DAY")},
post AS (SELECT * FROM (SELECT e.post_id, e.market_id, t.ts, t.c / t.q AS price, row_number() OVER (PARTITION BY e.post_id, e.market_id ORDER BY t.ts DESC) AS rn
    FROM e JOIN takers AS t ON e.market_id = t.market_id AND e.favored_id = t.outcome_id AND t.ts > e.moment + INTERVAL 10 DAY AND t.ts <= e.s_end) AS _x WHERE rn = 1),
x AS (SELECT e.*, coalesce(early, CASE WHEN pre.ts IS NULL THEN 'no favored-side trade in lookback' WHEN epoch(e.moment) - epoch(pre.ts) > 30 * 86400 THEN 'pre-news trade older than max_pre_age' END) AS excluded,
    pre.price AS p0, pre.ts AS pts, lead_.price AS p1, post.price AS p2
    FROM e LEFT JOIN pre USING (post_id, market_id) LEFT JOIN lead_ USING (post_id, market_id) LEFT JOIN post USING (post_id, market_id)),
m AS (SELECT post_id, market_id, moment, status, tier1, excluded, CASE WHEN early IS NULL THEN s_end < full_end END AS post_cut_short, CASE WHEN early IS NULL THEN p0 END AS pre_price,
    CASE WHEN early IS NULL THEN epoch(moment) - epoch(pts) END AS pre_age_s, CASE WHEN excluded IS NULL THEN p1 END AS lead_price, CASE WHEN excluded IS NULL THEN p0 - p1 END AS drift,
    CASE WHEN excluded IS NULL THEN pts > moment - INTERVAL 10 DAY END AS recent_pre_trade, CASE WHEN excluded IS NULL THEN p2 END AS post_price, CASE WHEN excluded IS NULL THEN p2 - p0 END AS move,
    CASE WHEN excluded IS NULL THEN coalesce(p2 - p0 >= 0.03, false) END AS moved FROM x)"""


def stale(name: str, threshold_rows: str) -> str:
    """Stale statistics of rows (post_id, market_id, threshold)."""
    return f"""{name} AS (SELECT h.post_id, h.market_id, count(*) FILTER (lv.price < threshold) AS fills, min(epoch(ts) - epoch(moment)) FILTER (lv.price < threshold) AS first_s, max(epoch(ts) - epoch(moment)) FILTER (lv.price < threshold) AS last_s,
    coalesce(sum(qty) FILTER (lv.price < threshold AND NOT ambiguous), 0) AS qty, coalesce(sum(qty * lv.price) FILTER (lv.price < threshold AND NOT ambiguous), 0) AS cost,
    coalesce(sum(qty) FILTER (lv.price < threshold AND ambiguous), 0) AS ambiguous_qty, coalesce(sum(qty) FILTER (lv.price < threshold), 0) AS qty_upper,
    coalesce(sum(qty) FILTER (lv.price < threshold AND NOT ambiguous AND epoch(ts) - epoch(moment) < 86400), 0) AS qty_0_1d,
    coalesce(sum(qty) FILTER (lv.price < threshold AND NOT ambiguous AND epoch(ts) - epoch(moment) >= 86400 AND epoch(ts) - epoch(moment) < 259200), 0) AS qty_1_3d,
    coalesce(sum(qty) FILTER (lv.price < threshold AND NOT ambiguous AND epoch(ts) - epoch(moment) >= 259200), 0) AS qty_3_10d
    FROM ({threshold_rows}) AS h LEFT JOIN lv ON h.post_id = lv.post_id AND h.market_id = lv.market_id GROUP BY h.post_id, h.market_id)"""


XP = stale("xp", "SELECT post_id, market_id, (pre_price + post_price) / 2 AS threshold FROM m WHERE post_price > pre_price")
