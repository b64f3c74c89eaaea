"""Prefix trie of conversations, families first.

Conversations of one family (the same base id) start with the same turns, so a family's rows meet by base id, are rebuilt, and become the family's
own small trie: one row for each node, however many members share it.  Only these rows are shuffled to merge equal
nodes of all families.

Nothing depends on how long a conversation is or how many share a node: turns are numbered from a sort by ranges, a node is named by sums of hashes
over its turns that blocks of a long conversation continue, and what a subtree holds is added up by
doubling the distance to the ancestor that gets it.  Only nodes with two or more members take part in that; below
them a subtree is one path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import discard, spread, written

#: Conversations of a family, and turns at most that one starts with from its base (fixed values).
FAMILY, HEADS = 20, 3
#: Turns of a conversation in a block, rows of families handled at once, and the width of the ranges of ids that are joined to one text.
BLOCK, CHUNK, RANGE = 1024, 1 << 17, 4096
MASK = (1 << 63) - 1
NODE = ["a", "b", "depth"]

FAMILIES = "a bigint, b bigint, depth bigint, pa bigint, pb bigint, conv_id bigint, n bigint, words bigint, ends array<bigint>"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, digest, words and the turn's place in its conversation; rows without a conv_id are left out.

    Rows are sorted by ranges; a range's rows are numbered where they are, and the numbers of rows before it, one
    for each range, make the places whole.  So a conversation of any length takes as many tasks as it needs.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = ["conv_id", "turn", "digest"]
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    held = written(dealt.withColumn("_i", F.monotonically_increasing_id()).drop("turn"), "turns")
    part, local = F.shiftright("_i", 33).alias("_part"), F.col("_i").bitwiseAND((1 << 33) - 1)
    sizes = held.groupBy(part).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = held.withColumn("_part", part).join(F.broadcast(sizes.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
    return placed.select("conv_id", "digest", "words", (F.col("_before") + local).alias("_at"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, conv_id, pos, digest, words of all turns as rebuilt; conv_id, length of all conversations)."""
    turns = numbered_turns(conversations)
    convs = turns.groupBy("conv_id").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)).cast("int")})
    ranked = turns.join(convs, "conv_id").withColumn("_rank", F.col("_at") - F.col("_first"))
    heads = ranked.filter((F.col("conv_id") == F.col("base")) & (F.col("_rank") < HEADS)).groupBy("base").agg(F.sort_array(F.collect_list(F.struct("_rank", "digest", "words"))).alias("_heads"))
    convs = convs.join(heads, "base", "left").withColumn("_heads", F.slice(F.coalesce("_heads", F.array().cast(heads.schema["_heads"].dataType)), F.lit(1), F.col("_h")))
    convs = convs.withColumn("_held", F.size("_heads")).withColumn("length", F.col("_held") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0)))
    convs = written(convs.select("base", "conv_id", "_first", "_h", "_held", "_heads", "length"), "conversations")
    own = turns.join(convs.drop("_heads"), "conv_id").withColumn("pos", F.col("_at") - F.col("_first") - F.col("_h") + F.col("_held")).filter(F.col("_at") - F.col("_first") >= F.col("_h"))
    given = convs.select("base", "conv_id", "length", F.posexplode("_heads").alias("pos", "_t")).select("base", "conv_id", "length", F.col("pos").cast("long").alias("pos"), "_t.digest", "_t.words")
    return own.select(*given.columns).unionByName(given), convs.select("conv_id", "length")


def _before(rows: DataFrame) -> DataFrame:
    """_ca, _cb: the sums of hashes of a conversation's earlier blocks, for conversations of several."""
    sums = rows.filter(F.col("length") > BLOCK).groupBy("conv_id", "_block").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("_xa", "_xb")])
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda c: F.expr(f"cast(pmod({c}, cast({MASK + 1} as decimal(38,0))) as bigint)")
    return sums.withColumns({c: F.sum(c).over(earlier) for c in ("_xa", "_xb")}).filter("_xa is not null").select("conv_id", "_block", whole("_xa").alias("_ca"), whole("_xb").alias("_cb"))


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of families from their sorted rows."""
    held: list[pa.Table] = []

    def of(t: pa.Table) -> pa.RecordBatch:
        get = lambda c: t[c].to_numpy().astype(np.int64)
        base, conv, pos, words, block = get("base"), get("conv_id"), get("pos"), get("words"), get("_block")
        n = len(conv)
        first = np.ones(n, bool)
        first[1:] = (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])
        begin = np.flatnonzero(first)
        of_run = np.cumsum(first) - 1
        lanes, above = [], []
        for x, c in (("_xa", "_ca"), ("_xb", "_cb")):
            add = get(x).astype(np.uint64)
            sums = np.cumsum(add)  # wraps around
            start = (sums[begin] - add[begin] - get(c).astype(np.uint64)[begin])[of_run]
            here = sums - start
            lanes.append((here & np.uint64(MASK)).astype(np.int64))
            above.append(((here - add) & np.uint64(MASK)).astype(np.int64))
        order = np.lexsort((conv, lanes[1], lanes[0], pos, base))
        same = np.ones(n, bool)
        same[1:] = np.any([x[order][1:] != x[order][:-1] for x in (base, pos, *lanes)], axis=0)
        at = np.flatnonzero(same)
        top = order[at]  # the smallest member
        node = np.cumsum(same) - 1
        ended = (pos == get("length") - 1)[order]
        ends = np.bincount(node[ended], minlength=len(at))
        offsets = np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(conv[order][ended]))
        values = [lanes[0][top], lanes[1][top], pos[top] + 1, above[0][top], above[1][top], conv[top], np.diff(np.append(at, n)), words[top]]
        return pa.RecordBatch.from_arrays([*[pa.array(v.astype(np.int64)) for v in values], lists], ["a", "b", "depth", "pa", "pb", "conv_id", "n", "words", "ends"])

    size = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        size += b.num_rows
        if size >= CHUNK:
            t = pa.concat_tables(held)
            key = t["base"].to_numpy(), t["_block"].to_numpy()
            last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]))
            whole = int(last[-1]) + 1 if len(last) else 0  # a family's block has at most FAMILY * BLOCK rows
            if whole:
                yield of(t.slice(0, whole))
            held, size = [t.slice(whole)], t.num_rows - whole
    if size:
        yield of(pa.concat_tables(held))


def family_nodes(rows: DataFrame, longest: int) -> DataFrame:
    """The nodes of each family below the root: names of the node and its parent, smallest member, members, words of the last turn, conversations that end there."""
    hashed = lambda seed: F.xxhash64(F.lit(seed), "pos", "digest").bitwiseAND(MASK)
    rows = rows.withColumns({"_block": F.floor(F.col("pos") / BLOCK).cast("long"), "_xa": hashed(1), "_xb": hashed(2)}).drop("digest")
    if longest > BLOCK:
        rows = rows.join(_before(rows), ["conv_id", "_block"], "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("_ca", "_cb")})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_ca", "_cb")})
    return spread(rows, "base", "_block").sortWithinPartitions("base", "_block", "conv_id", "pos").mapInArrow(_tries, FAMILIES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids from its ranges in order, one text after the other."""
    now, sha = None, None
    out: list[tuple] = []
    for b in batches:
        for a, c, depth, text in zip(*(b.column(k).to_pylist() for k in (*NODE, "text")), strict=True):
            if (a, c, depth) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (a, c, depth), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
        if len(out) > 10_000:
            yield _rows(out)
            out = []
    if now is not None:
        out.append((*now, sha.hexdigest()))
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """a, b, depth, ends_sha256 of nodes at which conversations (a, b, depth, conv_id) end; a node's ids are never held together."""
    some = ends.groupBy(*NODE, F.floor(F.col("conv_id") / RANGE).alias("_range")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("text"))
    return spread(some, *NODE).sortWithinPartitions(*NODE, "_range").mapInArrow(_digests, "a bigint, b bigint, depth bigint, ends_sha256 string")


def subtree_sums(shared: DataFrame, deepest: int) -> DataFrame:
    """a, b, depth, n_leaves, saved_tokens over whole subtrees of shared (a, b, depth, pa, pb, n_leaves, saved_tokens: what each node has itself).

    After k rounds a node has the sums of all nodes less than 2**k below it; the nodes 2**k above are each
    node's own ancestor's ancestors, so both distances double.
    """
    held, k = shared, 1
    while k <= deepest:
        below = held.filter(F.col("depth") >= k)
        add = below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - k).alias("depth")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        jump = held.filter(F.col("depth") >= k).select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + k).alias("depth"), F.col("pa").alias("_ja"), F.col("pb").alias("_jb"))
        got = held.join(add, NODE, "left").join(jump, ["pa", "pb", "depth"], "left")
        got = written(got.select(*NODE, F.col("_ja").alias("pa"), F.col("_jb").alias("pb"), (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_s", F.lit(0))).alias("saved_tokens")), "sums")
        discard(held)
        held, k = got, 2 * k
    return held


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Turns are in the order of `turn`, null first; rows that share a turn come in the order of the md5 digest of role and text, and repeated rows are turns
    of their own.  Null and empty roles or texts are the same.  Rows without a conv_id belong to no conversation; an id's base
    is the id less its remainder by 20, whose sign is the id's.  A text or conversation of any length is taken whole; nodes are equal when two sums
    of hashes of together 126 bits are.  Other columns are ignored; an empty table has no nodes, not even the root.
    """
    rows, convs = rebuilt(conversations)
    longest, root = convs.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0], (F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("depth"))
    families = written(family_nodes(rows, longest), "families")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).filter("n > 0").select(*root, F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), "conv_id", "n", F.lit(0).cast("long").alias("words"))
    merged = families.groupBy(*NODE).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.max("words").alias("words"))
    nodes = written(merged.unionByName(top), "nodes")
    ends = families.select(*NODE, F.explode("ends").alias("conv_id")).unionByName(convs.filter("length = 0").select(*root, "conv_id"))
    parents = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("_children"), F.count_if(F.col("n") == 1).alias("_single"))
    shared = nodes.filter("n > 1").join(parents, NODE, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_children", "_single")})
    shared = written(shared.select(*NODE, "pa", "pb", "conv_id", "_children", (F.col("_single") + (F.col("_children") == 0).cast("long")).alias("n_leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved_tokens")), "shared")
    deepest = shared.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    sums = subtree_sums(written(shared.drop("conv_id", "_children"), "own"), deepest).select(*NODE, "n_leaves", "saved_tokens")
    sums = shared.select(*NODE, "_children").join(sums, NODE)
    above = shared.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent"))
    got = nodes.join(sums, NODE, "left").join(end_digests(ends), NODE, "left").join(above, ["pa", "pb", "depth"], "left")
    # a node of one member has a child unless that ends here, and a parent of one member has the same one
    ended = F.col("ends_sha256").isNotNull()
    return got.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("_children", F.when(ended, 0).otherwise(1)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


SQL = rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % {FAMILY} AS base, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda s, x: list_reduce([CAST(1 AS BIGINT) for z in range(8)], lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END), xor(s, x)), CAST(4294967295 AS BIGINT)) AS crc FROM (SELECT DISTINCT c FROM t)),
h AS (SELECT c, base, xor(crc, 4294967295) % {HEADS + 1} AS h FROM c),
r AS (SELECT h.c, t.i, role, text FROM h JOIN t ON t.c = base AND t.i <= h UNION ALL SELECT h.c, t.i + 10, role, text FROM h JOIN t ON t.c = h.c AND t.i > h),
p AS (SELECT c, row_number() OVER w AS d, text, list(md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) OVER w AS path, count(*) OVER (PARTITION BY c) AS n FROM r WINDOW w AS (PARTITION BY c ORDER BY i)),
m AS (SELECT c, d, path, d = n AS ends, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM p UNION ALL SELECT c, 0, [], c NOT IN (SELECT c FROM r), 0 FROM h),
g AS (SELECT d, path, min(c) AS conv_id, count(*) AS n, max(words) AS words, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS e FROM m GROUP BY d, path),
k AS (SELECT a.*, b.conv_id AS parent, (SELECT count(*) FROM g AS x WHERE x.d = a.d + 1 AND x.path[1:a.d] = a.path) AS kids FROM g AS a LEFT JOIN g AS b ON b.d = a.d - 1 AND b.path = a.path[1:a.d - 1])
SELECT k.conv_id, k.d AS depth, k.parent AS parent_conv_id, k.n AS n_convs, k.kids AS n_children, count(*) FILTER (u.kids = 0) AS n_leaves, CAST(sum((u.n - 1) * u.words) AS BIGINT) AS saved_tokens, sha256(coalesce(k.e, '')) AS ends_sha256
FROM k JOIN k AS u ON u.d >= k.d AND u.path[1:k.d] = k.path GROUP BY ALL
"""
