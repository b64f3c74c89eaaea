"""Running sums in a global order, for groups of any size.

A window function gives a whole group to one task, which is right for a table that any task could hold.  Beyond that size rows are
sorted by ranges of group and order, so a large group takes several tasks; each task sums what it has, and one row for
each task tells the next how much of its first group came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import written


#: Bytes of a written table up to which one window does it.
SMALL = 32 << 20


def _bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows (_a, _b, weights _w0, _w1 and so on, others) what comes before each in its group and whether this is the first group of the task."""
    key, totals, first = None, None, True
    for b in batches:
        if not b.num_rows:
            continue
        weights = [x for x in b.schema.names if x.startswith("_w")]
        one, two, *each = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_a", "_b", *weights))
        fresh = np.ones(len(one), bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        fresh[0] = (one[0], two[0]) != key
        if totals is None or fresh[0]:
            first, totals = key is None, [0] * len(each)
        begins, group = np.flatnonzero(fresh), np.cumsum(fresh)
        before = []
        for total, w in zip(totals, each, strict=True):
            sums = np.cumsum(w) - w
            before.append(sums + np.concatenate([[total], -sums[begins]])[group])
        # the first group of the task: the one it began with
        opening = group <= int(key is None) if first else np.zeros(len(one), bool)
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, before), pa.array(opening)], [*b.schema.names, *[f"_before{x[2:]}" for x in weights], "_open"])
        first = first and bool(opening[-1])
        key, totals = (one[-1], two[-1]), [int(x[-1] + w[-1]) for x, w in zip(before, each, strict=True)]


def running_sums(rows: DataFrame, keys: list[str], order: list[str], weights: dict[str, Column], parts: int | None = None) -> DataFrame:
    """rows with a column for each name: the sum of its weight (whole numbers of 0 or more) over the rows of the same keys that come before.

    Rows that tie in the order come one after the other in some order that stays, as the sorted rows are written once.  Null keys are one
    group.  At most one row for each task reaches the driver.
    """
    spark, n = rows.sparkSession, range(len(weights))
    marked = rows.withColumns({"_a": F.xxhash64(F.lit(1), *keys), "_b": F.xxhash64(F.lit(2), *reversed(keys))} | {f"_w{k}": w.cast("long") for k, w in enumerate(weights.values())})
    # written first: its size decides, and sorting by ranges reads it twice
    marked = written(marked, "unordered")
    if parts is None and _bytes(marked) <= SMALL:
        before = Window.partitionBy("_a", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return written(marked.select(*rows.columns, *[F.coalesce(F.sum(f"_w{k}").over(before), F.lit(0)).alias(name) for k, name in enumerate(weights)]), "ordered")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*marked.schema.fields, *[T.StructField(f"_before{k}", T.LongType()) for k in n], T.StructField("_open", T.BooleanType())])
    dealt = marked.repartitionByRange(parts, "_a", "_b", *order).sortWithinPartitions("_a", "_b", *order)
    held = written(dealt.mapInArrow(_sums, schema).withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "ordered")
    after = F.struct("_a", "_b", F.array(*[F.col(f"_before{k}") + F.col(f"_w{k}") for k in n]).alias("sums"))
    tasks = held.groupBy("_part").agg(F.min_by(F.struct("_a", "_b"), "_i").alias("first"), F.max_by(after, "_i").alias("last")).orderBy("_part").collect()
    carries, was, totals = [], None, [0] * len(weights)
    for t in tasks:
        key, last = (t["first"]["_a"], t["first"]["_b"]), (t["last"]["_a"], t["last"]["_b"])
        carry = totals if key == was else [0] * len(weights)
        was, totals = last, [x + (c if key == last else 0) for x, c in zip(t["last"]["sums"], carry, strict=True)]
        carries.append((t["_part"], carry))
    held = held.join(F.broadcast(spark.createDataFrame(carries, "_part int, _carry array<bigint>")), "_part")
    return held.select(*rows.columns, *[(F.col(f"_before{k}") + F.when(F.col("_open"), F.col("_carry")[k]).otherwise(0)).alias(name) for k, name in enumerate(weights)])


def running(rows: DataFrame, keys: list[str], order: list[str], name: str, weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """One such sum; without a weight each row counts 1, so it is the row's number in its group, from 0."""
    return running_sums(rows, keys, order, {name: F.lit(1) if weight is None else weight}, parts)
