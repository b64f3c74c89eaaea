"""Exact n-gram Jaccard self-join by token groups, and its connected components.

1. Equal sets are one class.  Every class sends its shingles in sorted blocks of a
   few bytes a shingle; one that shares too few of its shingles with any others can
   link with nobody and is settled.  Only the rest (near copies, mostly) goes on.
2. Among these, frequent shingles come last in a global order, and every class emits an
   extended prefix under it: two that link share at least `shared(n)` shingles of
   their prefixes, n the smaller size.
3. Classes that meet at a shingle form that shingle's group, kept under the
   group's smallest class.  A class that meets others at too few of its shingles
   leaves; a group inside another is dropped.
4. Groups are verified in blocks of bounded size.  A block's documents are partitioned
   into small groups of similar ones, a sparse token-group matrix holds each small
   group's token union, and only groups whose union covers the required overlap with a
   query are opened.  Documents known to be connected are not compared again, and
   only a spanning forest leaves a block, never all pairs.
   A group of several blocks goes in two rounds: each block by itself, with a few
   representatives of the group in all of them; then only documents outside the group's
   main component meet the blocks of all others, so one large cluster of near copies
   is read once or twice, not once for each pair of blocks.
5. Alternating large-star and small-star steps turn the links into components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpecodec import slice_hash
from .common import discard, slabs, spread, texts_of, written
from .textscan import groups

WORDS = 5
#: Members of a group that one task compares with one another, and of the small groups in it.
BLOCK, SMALL = 1024, 16
#: A shingle is frequent in a slab of rows from SLAB_COUNT on, and in all rows at 1 document in FREQUENT (LEAST_DF at least).
SLAB_COUNT, FREQUENT, LEAST_DF = 4, 2000, 32
#: Members of a group that are in all its blocks in the first round.
REPRESENTATIVES = 8
#: Rows whose prefixes share a bucket: a class and its group's leader make a row in each bucket in which they meet.
BUCKET_ROWS = 8192
#: Buckets of whole sets at least; a class makes a row in each in which it meets others.  Their number grows with the
#: shingles, so that a bucket, which one task reads whole, has about the first number of them, or the second where there are more than MANY buckets.
BUCKETS, BUCKET_SHINGLES, MOST_SHINGLES, MANY = 64, 1 << 19, 1 << 23, 20_000
#: Keys with more than one in HOT of all rows are joined by broadcast: there are fewer than HOT.
HOT = 1024
#: The bits of a class that are its code.
CODE = (1 << 48) - 1
MIX = np.uint64(0xFF51AFD7ED558CCD)


def least(n):
    """Smallest overlap of a set of size n with anything it links with: 100 * i >= 75 * u needs i >= 3n/4."""
    return (3 * n + 3) // 4


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in groups(texts):
        out += _sets(texts[a:b])
    return out


def _sets(texts: list[str]) -> list[np.ndarray]:
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    word = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = slice_hash(data, start, end, 0)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    first_word = np.searchsorted(start, np.append(firsts, len(data) + 1))
    n = len(h)
    rolled = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS if len(rolled) else 0):
        rolled = rolled * MIX + h[k : k + len(rolled)]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xC4CEB9FE1A85EC53)
    rolled ^= rolled >> np.uint64(32)
    out = []
    for a, b in zip(first_word[:-1].tolist(), first_word[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8, salt=b"short").digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shared(n):
    """Prefix shingles that two linked sets share at least, n being the smaller size.

    With an overlap of at least the larger set's least(size), prefixes of
    size - least(size) + shared(size) shingles have that many in common.
    """
    return 1 + n // 10


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls, digest of each row's set."""

    def run(batches):
        for b in slabs(batches):
            sets = shingle_sets(texts_of(b.column(1)))
            digest = [digest_of(s) if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([key_of(d) for d in digest], pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "n", "cls", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls long, digest binary")


def often(docs: DataFrame) -> DataFrame:
    """token and df of shingles that are frequent in a slab of rows."""

    def run(batches):
        for b in slabs(batches):
            every = np.concatenate([*shingle_sets(texts_of(b.column(0))), np.zeros(0, np.uint64)])
            every.sort()
            cuts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            count = np.diff(np.append(cuts, len(every)))
            keep = count >= SLAB_COUNT
            yield pa.RecordBatch.from_arrays([pa.array(every[cuts[keep]].view(np.int64)), pa.array(count[keep], pa.int64())], ["token", "df"])

    return docs.select("text").mapInArrow(run, "token long, df long")


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def frequent(seen: DataFrame, rows: int) -> np.ndarray:
    """Frequent shingles, rarest first: at most (all shingles) / (documents / FREQUENT), so a bounded multiple of the mean set size."""
    found = seen.groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= max(LEAST_DF, rows // FREQUENT)).orderBy("df", "token").select("token").toArrow()
    return found.column(0).to_numpy().view(np.uint64)


def blocks(docs: DataFrame, hot: np.ndarray, buckets: int, whole: bool) -> DataFrame:
    """bucket and blocks of a slab's shingles: of whole sets, or of prefixes under the order that has the frequent ones last."""
    order = np.argsort(hot)
    sent = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    def run(batches):
        known, rank = sent.value
        for b in slabs(batches):
            found: set[int] = set()
            toks, owner, classes, sizes = [], [], [], []
            for s in shingle_sets(texts_of(b.column(0))):
                n = len(s)
                c = key_of(digest_of(s))
                if not n or c in found:
                    continue
                found.add(c)
                most = n if whole else n - least(n) + shared(n)
                if len(known) and not whole:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    is_hot = known[at] == s
                    if is_hot.any():
                        s = np.concatenate([s[~is_hot], s[is_hot][np.argsort(rank[at[is_hot]])]])
                toks.append(s[:most])
                owner.append(np.full(len(toks[-1]), len(classes), np.uint16))
                classes.append(c & CODE if whole else c)
                sizes.append(min(n, 0xFFFFFFFF))
            if not toks:
                continue
            tok, own, classes, sizes = np.concatenate(toks), np.concatenate(owner), np.array(classes), np.array(sizes, np.uint32)
            where = (tok >> np.uint64(32)) % np.uint64(buckets)
            by = np.argsort(where << np.uint64(32) | tok & np.uint64(0xFFFFFFFF))
            tok, own, where = tok[by], own[by], where[by]
            cuts = np.searchsorted(where, np.arange(buckets + 1, dtype=np.uint64))
            rows = [(j, *block(tok[x:y], own[x:y], classes, sizes, whole)) for j, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], ["bucket", "toks", "own", "classes", "sizes"])

    return docs.select("text").mapInArrow(run, "bucket int, toks binary, own binary, classes binary, sizes binary")


def block(tok: np.ndarray, own: np.ndarray, classes: np.ndarray, sizes: np.ndarray, whole: bool) -> tuple[bytes, bytes, bytes, bytes]:
    """Of whole sets, the classes go as codes of 6 bytes and without their sizes: there are many of them in a block."""
    used, back = np.unique(own, return_inverse=True)
    who = classes[used].astype("<i8")
    if whole:
        who = who.view(np.uint8).reshape(-1, 8)[:, :6]
    # in a bucket, the low 32 bits tell shingles apart well enough: a chance meeting only costs a comparison
    return (tok & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), back.astype("<u2").tobytes(), who.tobytes(), b"" if whole else sizes[used].tobytes()


def codes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<i8")[:, 0]


def by_bucket(blobs: DataFrame, buckets: int, join, schema: str, whole: bool) -> DataFrame:
    """Applies join to the blocks of each bucket; only shingles that occur again in the bucket are handed on: as tok, code where sets are whole, else as tok, cls, size."""

    def run(batches):
        bucket, parts = None, []
        for b in batches:
            cols = [b.column(i) for i in range(5)]
            for r in range(b.num_rows):
                now = cols[0][r].as_py()
                if now != bucket:
                    yield from given(parts)
                    bucket, parts = now, []
                parts.append(tuple(cols[i][r].as_py() for i in range(1, 5)))
        yield from given(parts)

    def given(parts):
        if not parts:
            return
        tok = np.concatenate([np.frombuffer(t, "<u4") for t, *_ in parts])
        by = np.argsort(tok)
        again = tok[by]
        twice = np.zeros(len(by), bool)
        twice[1:] = again[1:] == again[:-1]
        twice[:-1] |= twice[1:]
        by = by[twice]  # the others meet nobody
        if not len(by):
            return
        cls = np.concatenate([(codes(c) if whole else np.frombuffer(c, "<i8"))[np.frombuffer(o, "<u2")] for _, o, c, _ in parts])[by]
        if whole:
            yield from join(tok[by], cls)
            return
        size = np.concatenate([np.frombuffer(s, "<u4").astype(np.int64)[np.frombuffer(o, "<u2")] for _, o, _, s in parts])[by]
        yield from join(tok[by], cls, size)

    placed = blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(run, schema)


def coverage(blobs: DataFrame, buckets: int) -> DataFrame:
    """code, met: how many of the shingles of the classes of a code other codes have too.

    Classes of one code are taken together, which only lets more of them go on; a shingle
    that two such classes share and no other is not met, which 48 bits make as good as impossible.
    """

    def join(tok, code):
        by = np.lexsort((code, tok))
        tok, code = tok[by], code[by]
        new = np.ones(len(tok), bool)
        new[1:] = tok[1:] != tok[:-1]
        once = new.copy()
        once[1:] |= code[1:] != code[:-1]  # a class that several slabs hold counts once
        run_of = np.cumsum(new) - 1
        code, met = np.unique(code[(np.bincount(run_of, weights=once) > 1)[run_of] & once], return_counts=True)
        if len(code):
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(met.astype(np.int64))], ["code", "met"])

    return by_bucket(blobs, buckets, join, "code long, met long", whole=True).groupBy("code").agg(F.sum("met").alias("met"))


def meet(blobs: DataFrame, buckets: int) -> DataFrame:
    """leader, member, n, met: classes that meet at prefix shingles, each group under its smallest class; n is the member's size, met the number of shingles at which it meets others there."""

    def join(tok, cls, size):
        by = np.lexsort((cls, size, tok))
        tok, cls, size = tok[by], cls[by], size[by]
        # neighbours in a run of sizes that can link; a larger step in size parts them
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (4 * size[:-1] < 3 * size[1:])
        once = np.ones(len(tok), bool)
        once[1:] = new[1:] | (cls[1:] != cls[:-1])  # a class that several slabs hold counts once
        run_of = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        low, high = np.minimum.reduceat(cls, heads), np.maximum.reduceat(cls, heads)
        keep = (low < high)[run_of] & once
        leader, cls, size = low[run_of[keep]], cls[keep], size[keep]
        by = np.lexsort((cls, leader))
        leader, cls, size = leader[by], cls[by], size[by]
        if not len(cls):
            return
        first = np.flatnonzero(np.concatenate([[True], (cls[1:] != cls[:-1]) | (leader[1:] != leader[:-1])]))
        yield pa.RecordBatch.from_arrays([pa.array(leader[first]), pa.array(cls[first]), pa.array(size[first]), pa.array(np.diff(np.append(first, len(cls))).astype(np.int64))], ["leader", "member", "n", "met"])

    return by_bucket(blobs, buckets, join, "leader long, member long, n long, met long", whole=False).groupBy("leader", "member").agg(F.max("n").alias("n"), F.sum("met").alias("met"))


def by_size(rows: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """rows with the columns of sizes (leader, size, others; a written table) by leader: leaders with more than one in HOT of `total` rows at least by broadcast, so none of them fills a task."""
    hot = F.broadcast(sizes.filter(F.col("size") * HOT > total))
    return rows.join(hot, "leader").unionByName(rows.join(hot, "leader", "left_anti").join(sizes.filter(F.col("size") * HOT <= total), "leader"))


def able(g: DataFrame) -> DataFrame:
    """(leader, member) of the classes that meet others at enough shingles to link with one, in groups of at least two."""
    enough = g.groupBy("member").agg(F.max("n").alias("n"), F.sum("met").alias("met")).filter("met >= 1 + floor(ceil(3 * n / 4) / 10)").select("member")
    kept = written(g.select("leader", "member").join(enough, "member"), "enough")
    sizes = written(kept.groupBy("leader").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    out = written(by_size(kept, sizes, kept.count()).select("leader", "member"), "able")
    discard(kept, sizes)
    return out


def outer_groups(g: DataFrame) -> DataFrame:
    """(leader, size, member) without the groups whose members all are in one group with a smaller leader."""
    total, size = g.count(), g.groupBy("leader").agg(F.count("*").alias("size"))
    first = g.groupBy("member").agg(F.min("leader").alias("outer")).filter("outer < member").withColumnRenamed("member", "leader")
    inner = written(size.join(first, "leader"), "nested")
    nested = by_size(g, inner, total)
    inside = nested.join(g.select(F.col("leader").alias("outer"), "member"), ["outer", "member"]).groupBy("leader").agg(F.count("*").alias("inside"))
    stays = written(size.join(inside, "leader", "left").filter("inside is null or inside < size").select("leader", "size"), "outer")
    discard(inner)
    return by_size(g, stays, total)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def forest(sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect just what the links among these sets connect. side: with both values there, only pairs across count."""
    if not sets:
        return []
    across = bool((side != side[0]).any())
    ids = np.arange(len(sets))
    while True:  # a set's overlap with the union of the rest bounds every overlap
        size = np.fromiter((len(sets[i]) for i in ids), np.int64, len(ids))
        tok, code = np.unique(np.concatenate([*(sets[i] for i in ids), np.zeros(0, np.uint64)]), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), size)
        if across:
            there = [np.bincount(code[side[ids][owner] == s], minlength=len(tok)) > 0 for s in (0, 1)]
            met = np.where(side[ids][owner] == 0, there[1][code], there[0][code])
        else:
            met = np.bincount(code, minlength=len(tok))[code] > 1
        cover = np.bincount(owner[met], minlength=len(ids))
        keep = cover >= least(size)
        if keep.all():
            break
        ids = ids[keep]
    if len(ids) < 2:
        return []
    # small groups of similar sets, one side each; the matrix has a token's groups in a row
    codes = np.split(code, np.cumsum(size)[:-1])
    order = sorted(range(len(ids)), key=lambda i: (side[ids[i]], codes[i][: min(2, len(codes[i]))].tolist(), size[i]))
    cut = [0]
    for k in range(1, len(order)):
        if k - cut[-1] >= SMALL or (across and side[ids[order[k]]] != side[ids[order[k - 1]]]):
            cut.append(k)
    members = [order[a:b] for a, b in zip(cut, [*cut[1:], len(order)], strict=True)]
    cells = np.unique(np.concatenate([np.unique(np.concatenate([codes[i] for i in m])) * len(members) + j for j, m in enumerate(members)]))
    row, column = cells // len(members), cells % len(members)
    row_at = np.searchsorted(row, np.arange(len(tok) + 1))
    joined = [np.concatenate([codes[i] for i in m]) for m in members]
    heads = [np.concatenate([[0], np.cumsum([size[i] for i in m])[:-1]]).astype(np.int64) for m in members]
    mask, union, out = np.zeros(len(tok), bool), Union(len(ids)), []
    for j, m in enumerate(members):
        for q in m:
            if across and side[ids[q]] == 1:
                continue
            mine = codes[q]
            spans = row_at[mine], row_at[mine + 1]
            length = spans[1] - spans[0]
            ends = np.cumsum(length)
            hits = column[np.arange(ends[-1]) + np.repeat(spans[0] - (ends - length), length)]
            bound = np.bincount(hits, minlength=len(members))
            mask[mine] = True
            for o in np.flatnonzero(bound >= least(size[q])).tolist():
                if (not across and o < j) or (across and side[ids[members[o][0]]] == 0):
                    continue
                root = union.root(q)
                if all(union.root(x) == root for x in members[o]):
                    continue
                both = np.add.reduceat(mask[joined[o]].astype(np.int64), heads[o])
                for x, i in zip(members[o], both.tolist(), strict=True):
                    if x != q and 7 * i >= 3 * (int(size[q]) + int(size[x])) and union.root(x) != (root := union.root(q)):
                        union.up[union.root(x)] = root
                        out.append((int(ids[q]), int(ids[x])))
            mask[mine] = False
    return out


def roots(links: list[tuple[int, int]], ids: list) -> list[tuple]:
    """The links' components as stars: each document with the smallest one it is connected with in the block."""
    place = {x: k for k, x in enumerate(sorted({p for link in links for p in link}, key=lambda p: ids[p]))}
    order, union = sorted(place, key=place.get), Union(len(place))
    for a, b in links:
        x, y = union.root(place[a]), union.root(place[b])
        union.up[max(x, y)] = min(x, y)
    return [(ids[order[k]], ids[order[union.root(k)]]) for k in range(len(order)) if union.root(k) != k]


def blocked(members: DataFrame) -> DataFrame:
    """Places (doc_id, leader, one, two, own) for the first round: each member in one block of its group, representatives in all."""
    placed = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    chosen = placed.filter("blocks > 1").withColumn("_nth", F.row_number().over(Window.partitionBy("leader").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id"))).filter(F.col("_nth") <= REPRESENTATIVES)
    also = chosen.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("block <> own").withColumn("own", F.col("block"))
    every = placed.select("doc_id", "leader", "own").unionByName(also.select("doc_id", "leader", "own"))
    return every.select("doc_id", "leader", F.col("own").alias("one"), F.col("own").alias("two"), "own")


def apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """Places for the second round: documents of large groups outside the group's main component of `found` (node, component) meet all other documents of their group."""
    large = members.filter(F.col("size") > BLOCK).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counted = large.groupBy("leader", "component").agg(F.count("*").alias("n"))
    main = written(counted.groupBy("leader").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("size")).filter("inside < size"), "main")
    rows = by_size(large.drop("size"), main, members.count())
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    outside = F.col("component") != F.col("main")
    rows = rows.withColumns({"out": outside, "a": blocks(F.col("size") - F.col("inside")), "b": blocks(F.col("inside"))})
    part = F.pmod(F.xxhash64("doc_id"), F.when(F.col("out"), F.col("a")).otherwise(F.col("b"))).cast("int")
    rows = rows.withColumn("own", F.when(F.col("out"), part).otherwise(F.col("a") + part))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("a") + F.col("b")).otherwise(F.col("a")) - 1)))
    return rows.select("doc_id", "leader", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own")


def verified(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b) links between documents that share a place (leader, one, two): the components of each place, as stars; where one and two differ, of pairs across."""
    rows = spread(docs.select("doc_id", "text").join(placed, "doc_id"), "leader", "one", "two").sortWithinPartitions("leader", "one", "two")

    def run(batches):
        key, ids, own, sets = None, [], [], []

        def found():
            if not ids:
                return
            side = np.array([int(o != key[1]) for o in own]) if key[1] != key[2] else np.zeros(len(own), np.int64)
            links = roots(forest(sets, side), ids)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

        for b in slabs(batches, 1024):
            cols = [b.column(i).to_pylist() for i in range(5)]
            got = shingle_sets(texts_of(b.column(5)))
            for r, s in enumerate(got):
                now = (cols[1][r], cols[2][r], cols[3][r])
                if now != key:
                    yield from found()
                    key, ids, own, sets = now, [], [], []
                ids.append(cols[0][r])
                own.append(cols[4][r])
                sets.append(s)
        yield from found()

    return rows.select("doc_id", "leader", "one", "two", "own", "text").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node reachable. Alternating large and small stars; each round is a written table."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not stars(edges):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        down = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        was, edges = edges, written(down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "stars")
        discard(was)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def stars(edges: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child: then each parent is its component's smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Null, empty and wordless texts have an empty set and link with nothing;
    equal sets always link; a doc_id that repeats is one document per row with
    the same set taken from each; a row without a doc_id links only through
    equal rows that have one, else its component_id is null; a table without
    rows gives none; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = written(signatures(docs), "sets")
    classes = written(sig.filter("n > 0").groupBy("cls", "digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")
    buckets = bucket_count(sig.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long"))).first()[0])
    none = np.zeros(0, np.uint64)
    covered = written(coverage(blocks(docs, none, buckets, whole=True), buckets), "covered")
    going = classes.withColumn("code", F.col("cls").bitwiseAND(F.lit(CODE))).join(covered, "code").filter("4 * met >= 3 * n").select(F.col("rep").alias("doc_id")).distinct()
    rest = written(docs.join(going, "doc_id"), "near")
    rows = rest.count()
    fewer = max(1, -(-rows // BUCKET_ROWS))
    met = written(meet(blocks(rest, frequent(often(rest), rows), fewer, whole=False), fewer), "met")
    discard(covered)
    meeting = able(met)
    groups_ = outer_groups(meeting)
    members = written(groups_.join(classes.select(F.col("cls").alias("member"), F.col("rep").alias("doc_id")), "member").select("leader", "size", "doc_id"), "members")
    links = written(verified(rest, blocked(members)), "found")
    if not members.filter(F.col("size") > BLOCK).isEmpty():
        links = links.unionByName(verified(rest, apart(members, components(links))))
    found = written(components(links), "components")
    discard(met, meeting, rest, members)
    several = classes.filter("copies > 1").select("cls", "digest", "rep")
    out = sig.join(several, ["cls", "digest"], "left").withColumn("node", F.coalesce("rep", "doc_id")).join(found, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def bucket_count(shingles: int) -> int:
    each = min(MOST_SHINGLES, max(BUCKET_SHINGLES, shingles // MANY))
    return max(BUCKETS, -(-shingles // each))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM t),
x AS (SELECT doc_id, unnest(g) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x AS a JOIN x AS b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN s AS sa ON a = sa.doc_id JOIN s AS sb ON b = sb.doc_id WHERE 100 * n >= 75 * (len(sa.g) + len(sb.g) - n)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT u.b, r.c FROM r JOIN u ON r.doc_id = u.a)
SELECT s.doc_id, len(any_value(s.g)) AS n_shingles, min(r.c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""
