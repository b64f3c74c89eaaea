"""Exact quantiles of groups of any size.

Equal values are counted first, on the map side; the counts are summed up in the order of values by ranges, so that a
large group takes several tasks, and the values whose counts hold the wanted ranks are picked.  No
list or map of a group's values is ever held.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import running


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """A join on the columns of `by` in which NULL equals NULL; right has one row for each group."""
    named = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"_by_{c}"]) for c in by], F.lit(True))
    return left.join(named, same, how).drop(*[f"_by_{c}" for c in by])


def group_quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float | None]]) -> DataFrame:
    """by and one column for each wanted name: of (column, q) the value at the nearest rank, halves to the even one; with q None the median.

    NULLs don't count; a group without a value for a column has NULL there, and one without any value has no row.
    """
    columns = sorted({c for c, _ in wanted.values()})
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("_s")).select(*by, "_s.*").filter("_v is not null")
    counts = long.groupBy(*by, "_c", "_v").agg(F.count("*").alias("_n"))
    placed = running(counts, [*by, "_c"], ["_v"], "_before", F.col("_n"))
    totals = placed.groupBy(*by, "_c").agg((F.sum("_n") - 1).alias("_last"))
    ranked = join_groups(placed, totals, [*by, "_c"], "inner")

    def at(column: str, rank: Column) -> Column:
        return F.max(F.when((F.col("_c") == column) & (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_v")))

    def picked(column: str, q: float | None) -> Column:
        if q is not None:
            return at(column, F.bround(F.lit(q) * F.col("_last")).cast("long"))
        return (at(column, F.floor(F.col("_last") / 2)) + at(column, F.ceil(F.col("_last") / 2))) / 2

    return ranked.groupBy(*by).agg(*[picked(*how).alias(name) for name, how in wanted.items()])
