"""Validated ingestion of trade prints."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import UUID, number, trade_time


class InvalidRows(ValueError):
    """Rows of an input that break a rule, with their number and the first five row numbers."""


#: Rules in their order: (message, condition on raw rows under which a row is bad; NULL counts as bad).
def rules() -> list[tuple[str, Column]]:
    legs = F.col("legs").try_cast("smallint")
    cost, qty = number(F.col("cost")), number(F.col("qty"))
    return [
        ("side must be TAKER or MAKER", ~F.col("side").isin("TAKER", "MAKER")),
        ("bad timestamp", trade_time(F.col("timestamp")).isNull()),
        ("bad outcomeId or marketId", ~(F.rlike("outcomeId", F.lit(UUID)) & F.rlike("marketId", F.lit(UUID)))),
        ("legs, cost or qty is not a number", legs.isNull() | cost.isNull() | qty.isNull()),
        ("qty must be > 0 and cost >= 0", ~((qty > 0) & (cost >= 0))),
    ]


def violations(raw: DataFrame) -> DataFrame:
    """rule, message, bad (number of rows), rows (their first five numbers) for every rule that some row breaks; one pass over the rows."""
    flags = [F.coalesce(bad, F.lit(True)) for _, bad in rules()]
    first = F.coalesce(*[F.when(flag, F.lit(n)) for n, flag in enumerate(flags)])
    broken = raw.select("row_num", first.alias("rule")).filter("rule is not null")
    five = Window.partitionBy("rule").orderBy("row_num")
    counted = broken.groupBy("rule").agg(F.count("*").alias("bad"))
    shown = broken.withColumn("nth", F.row_number().over(five)).filter("nth <= 5").groupBy("rule").agg(F.sort_array(F.collect_list("row_num")).alias("rows"))
    message = F.element_at(F.array(*[F.lit(m) for m, _ in rules()]), F.col("rule") + 1)
    return counted.join(shown, "rule").select("rule", message.alias("message"), "bad", "rows")


def check(raw: DataFrame) -> None:
    """Raises on the first rule that rows break."""
    worst = violations(raw).orderBy("rule").limit(1).collect()
    if worst:
        raise InvalidRows(f"{worst[0]['message']}: {worst[0]['bad']} rows, first {worst[0]['rows']}")


def flag_ambiguous(trades: DataFrame) -> DataFrame:
    """taker_count: takers at the same time in the same market; ambiguous if there are several.  trades may have `n`, the number of prints in a row."""
    same = Window.partitionBy("ts", "market_id")
    number = F.col("n") if "n" in trades.columns else F.lit(1)
    takers = F.sum(F.when(F.col("side") == "TAKER", number).otherwise(0)).over(same)
    return trades.withColumn("taker_count", takers.cast("smallint")).withColumn("ambiguous", F.col("taker_count") > 1)


def parse_trades(raw: DataFrame, validate: bool = True) -> DataFrame:
    """Typed trades from raw string columns and row_num."""
    if validate:
        check(raw)
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    cost, qty = number(F.col("cost")), number(F.col("qty"))
    typed = raw.select(
        trade_time(F.col("timestamp")).alias("ts"), F.col("row_num").cast("int").alias("row_num"), F.col("outcomeId").alias("outcome_id"), F.col("marketId").alias("market_id"), F.col("contractSeries").alias("contract_series"),
        empty("league").alias("league"), empty("marketType").alias("market_type"), F.col("tradeType").alias("trade_type"), F.col("legs").try_cast("smallint").alias("legs"), cost.alias("cost"), qty.alias("qty"), (cost / qty).alias("price"), "side",
    )
    return flag_ambiguous(typed)


def for_day(trades: DataFrame, day: date, source: str = "public_csv") -> DataFrame:
    """Trades as they are stored: source and the trading day of their file first."""
    return trades.select(F.lit(source).alias("source"), F.lit(day).alias("file_date"), *trades.columns)


def file_days(low: Column, high: Column) -> Column:
    """Condition on file_date that holds for all rows with low <= ts <= high: a trading day and a UTC day differ by one at most, so partitions prune."""
    return (F.col("file_date") >= F.date_sub(F.to_date(low), 1)) & (F.col("file_date") <= F.date_add(F.to_date(high), 1))


def missing_days(days: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Days between the first and last listed `day` (of each group) that are not listed; groups are not NULL."""
    by = by or []
    span = days.groupBy(*by).agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null")
    return span.select(*by, F.explode(F.sequence("a", "b")).alias("day")).join(days.select(*by, "day").distinct(), [*by, "day"], "left_anti")
