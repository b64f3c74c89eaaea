"""Expected moves from earlier, settled events: an expanding median with a ladder of fallbacks.

As a join each rung would make a row for every target and earlier row of its group, and a window has no exact median.  Here both a
group's times and its values are numbered in a global order, and a time is just the number of rows that
settled before it.  Blocks of consecutive numbers are small tasks of their own: the median of a block's times can't move further
than the block has rows, so it lies among the block's rows and a few more than as many earlier rows around
the earlier rows' middle.  Counts by block of times and block of values, summed over earlier times, tell which values
those are.  So a group of any size, also one of all rows, is spread over all tasks, and a block holds a bounded number of rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import plus
from tidemark.operators.ordered import running
from tidemark.plans.params import Params
from tidemark.scratch import written

#: Rows of a block at least; with more than BLOCK**2 rows blocks grow as their square root, so that there are no more pairs of blocks than rows.
BLOCK = 4096
#: Blocks of times that get their earlier rows from one copy of a block of values.
SHARED = 16


def fit_rows(measured: DataFrame, p: Params) -> DataFrame:
    """Measured news that may teach: in the regular season, moved or not but measured, not excluded and not cut short."""
    usable = F.col("week").isNotNull() & F.col("move").isNotNull() & F.col("excluded").isNull() & ~F.coalesce("post_cut_short", F.lit(False))
    return measured.filter(usable).select("post_id", "status", "kind", "tier1", "move", plus(F.col("at"), p.settle).alias("settled_at"))


def running_medians(times: np.ndarray, settled: np.ndarray, moves: np.ndarray, posts: np.ndarray | None = None, least: int = 1, middle: tuple = ((), ()), left_out: tuple[int, int] = (0, 0)) -> np.ndarray:
    """For each time the median of the moves settled before it, NaN if fewer than `least` distinct posts speak.

    Two heaps hold the halves, so n rows cost n log n instead of a pair for every time and earlier row.  They may start
    from the middle of rows that are known already: the values below and above it, and how many of either side were left out.
    """
    out = np.full(len(times), np.nan)
    order = np.argsort(settled, kind="stable")
    low, high = [-x for x in middle[0]], list(middle[1])
    heapq.heapify(low)
    heapq.heapify(high)
    seen: set = set()
    at = 0
    for k in np.argsort(times, kind="stable").tolist():
        while at < len(order) and settled[order[at]] < times[k]:
            x = float(moves[order[at]])
            if posts is not None:
                seen.add(posts[order[at]])
            heapq.heappush(high, -heapq.heappushpop(low, -x))
            if len(high) + left_out[1] > len(low) + left_out[0]:
                heapq.heappush(low, -heapq.heappop(high))
            at += 1
        if low and (posts is None or len(seen) >= least):
            out[k] = -low[0] if len(low) + left_out[0] > len(high) + left_out[1] else (high[0] - low[0]) / 2
    return out


def _block_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_g, n, median) of the asked numbers of each block; its rows are sorted, of kinds 0 (earlier rows by value), 1 (the block's rows), 2 (asked numbers)."""
    held: list[pa.Table] = []

    def of(t: pa.Table) -> pa.RecordBatch:
        kind, n, move = t["kind"].to_numpy(), t["n"].to_numpy(), t["move"].to_numpy()
        earlier, asked = move[kind == 0], n[kind == 2]
        begins, below = (int(t["begins"][0].as_py()), int(t["below"][0].as_py())) if len(earlier) else (0, 0)
        half = (begins + 1) // 2
        middle = np.sort(earlier)
        cut = max(0, half - below)
        got = running_medians(asked, n[kind == 1], move[kind == 1], None, 1, (middle[:cut].tolist(), middle[cut:].tolist()), (below, begins - below - len(middle)))
        return pa.RecordBatch.from_arrays([pa.array([t["_g"][0].as_py()] * len(asked), pa.string()), pa.array(asked.astype(np.int64)), pa.array(got)], ["_g", "n", "median"])

    for b in batches:
        group, block = b.column("_g").dictionary_encode().indices.to_numpy(), b.column("block").to_numpy()
        ends = np.flatnonzero(np.append((group[1:] != group[:-1]) | (block[1:] != block[:-1]), True)) + 1
        for at, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            part = pa.Table.from_batches([b.slice(at, end - at)])
            if held and (held[0]["_g"][0], held[0]["block"][0]) != (part["_g"][0], part["block"][0]):
                yield of(pa.concat_tables(held))
                held = []
            held.append(part)
    if held:
        yield of(pa.concat_tables(held))


def _middles(rows: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(_g, block, move, begins, below) of the earlier rows around the middle for each asked block; rows: _g, s (number by time), r (by value), move."""
    cells = rows.groupBy("_g", F.floor(F.col("s") / width).alias("tb"), F.floor(F.col("r") / width).alias("vb")).agg(F.count("*").alias("c"))
    # every pair of a block of times and a block of values, with the rows of earlier times in it, and then in all lower values
    blocks = rows.groupBy("_g").agg(F.floor(F.max("s") / width).alias("_last"))
    long = lambda x: F.lit(x).cast("long")
    grid = blocks.select("_g", "_last", F.explode(F.sequence(long(1), F.col("_last") + 1)).alias("tb")).select("_g", "tb", F.explode(F.sequence(long(0), F.col("_last"))).alias("vb"))
    counts = grid.join(cells.withColumn("tb", F.col("tb") + 1), ["_g", "tb", "vb"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    earlier = counts.withColumn("p", F.sum("c").over(Window.partitionBy("_g", "vb").orderBy("tb")))
    summed = earlier.withColumn("q", F.sum("p").over(Window.partitionBy("_g", "tb").orderBy("vb"))).withColumn("begins", F.col("tb") * width)
    half = F.floor(F.col("begins") / 2)
    ranges = summed.filter((F.col("p") > 0) & (F.col("q") > half - width - 1) & (F.col("q") - F.col("p") <= half + width // 2 + 2)).select("_g", "tb", "vb", "begins", (F.col("q") - F.col("p")).alias("_under"))
    ranges = ranges.join(asked.select("_g", F.col("block").alias("tb")).distinct(), ["_g", "tb"], "left_semi")
    ranges = written(ranges.withColumn("below", F.min("_under").over(Window.partitionBy("_g", "tb"))).withColumn("copy", F.floor(F.col("tb") / SHARED)), "middles")
    copies = ranges.groupBy("_g", "vb").agg(F.collect_set("copy").alias("copies"))
    dealt = rows.withColumns({"own": F.floor(F.col("s") / width), "vb": F.floor(F.col("r") / width)}).join(copies, ["_g", "vb"]).withColumn("copy", F.explode("copies"))
    return dealt.join(ranges, ["_g", "vb", "copy"]).filter("own < tb").select("_g", F.col("tb").alias("block"), "move", "begins", "below")


def expanding_medians(targets: DataFrame, rows: DataFrame, id_: list[str], least: int, block: int = BLOCK) -> DataFrame:
    """id_, _g, median of targets (id_, _g, at) whose group's rows (_g, settled_at, move, post_id) that settled before `at` come from `least` distinct posts; others are left out."""
    firsts = rows.groupBy("_g", "post_id").agg(F.min("settled_at").alias("first"))
    nth = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy("first"))).filter(F.col("_n") <= least)
    since = nth.filter(F.col("_n") == least).select("_g", F.col("first").alias("_since"))
    able = targets.join(since, "_g").filter(F.col("at") > F.col("_since")).select(*id_, "_g", "at")
    times = able.select("_g", F.col("at").alias("t")).distinct().select("_g", "t", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("move"))
    both = times.unionByName(rows.select("_g", F.col("settled_at").alias("t"), F.lit(1).alias("kind"), "move"))
    seen = running(both, ["_g"], ["t", "kind"], "n", F.col("kind"))
    taught = running(seen.filter("kind = 1").select("_g", F.col("n").alias("s"), "move"), ["_g"], ["move", "s"], "r")
    width = max(block, math.isqrt(taught.count()))
    asked = seen.filter("kind = 0").select("_g", "n").distinct().withColumn("block", F.floor(F.col("n") / width))
    whole = lambda c: F.lit(c).cast("long")
    rows_of = taught.select("_g", F.floor(F.col("s") / width).alias("block"), whole(1).alias("kind"), F.col("s").alias("n"), "move", whole(None).alias("begins"), whole(None).alias("below"))
    rows_of = rows_of.unionByName(_middles(taught, asked, width).select("_g", "block", whole(0).alias("kind"), whole(None).alias("n"), "move", "begins", "below"))
    rows_of = rows_of.unionByName(asked.select("_g", "block", whole(2).alias("kind"), "n", F.lit(None).cast("double").alias("move"), whole(None).alias("begins"), whole(None).alias("below")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    medians = rows_of.repartition(parts, "_g", "block").sortWithinPartitions("_g", "block", "kind").mapInArrow(_block_medians, "_g string, n bigint, median double")
    found = seen.filter("kind = 0").select("_g", F.col("t").alias("at"), "n").join(medians, ["_g", "n"])
    return able.join(found.select("_g", "at", "median"), ["_g", "at"]).select(*id_, "_g", "median")


def expected_moves(targets: DataFrame, rows: DataFrame, id_: list[str], p: Params, control: bool = False) -> DataFrame:
    """targets (id_, at, week, status, kind, tier1) with expected_move: the first rung that has fit_min_events distinct posts, NULL before week 2.

    News climb from (status, kind, tier1) to (status); control posts, pooled over statuses, from (kind, tier1) to all.  Both
    rungs are groups of one pass; the targets' rows are told apart by id_.
    """
    ladder = [["kind", "tier1"], []] if control else [["status", "kind", "tier1"], ["status"]]
    rung = lambda n, keys: F.to_json(F.struct(F.lit(n).alias("rung"), *keys), {"ignoreNullFields": "false"})
    rungs = F.explode(F.array(*[rung(n, keys) for n, keys in enumerate(ladder)])).alias("_g")
    medians = expanding_medians(targets.filter("week >= 2").select(*id_, "at", rungs), rows.select("settled_at", "move", "post_id", rungs), id_, p.fit_min_events)
    first = medians.groupBy(*id_).agg(F.min_by("median", "_g").alias("expected_move"))  # the rung leads the group's name
    return targets.join(first, id_, "left")
