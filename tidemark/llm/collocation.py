"""Phrase collocations by suffix counting: truncated suffixes dealt by language and first word, sorted, all prefixes counted in one pass.

Every word of a piece starts a suffix of at most MAX_WORDS words.  A slab of text adds up equal suffixes and sends one row for each language
and first word: the sorted rests of its suffixes and how often each came.  A first word that holds more than a task's share of all words is
dealt by its first two words instead, a frequent pair by three, a frequent triple by four; prefixes shorter than
what a row is dealt by are counted in parts, which are added up afterwards.  The rows of a key meet in sorted
order, whole keys at a time in blocks of bounded size; there suffixes are sorted reverse-lexicographically, and a
prefix is complete where the next suffix shares fewer words: what a stack would pop is read from one running sum.
The parts of a phrase are at least as frequent as the phrase, so the frequent phrases alone are joined with themselves for scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slabs, written

#: Words of a phrase at most, occurrences at least, phrases listed for a language, and the share of its occurrences (in percent) from which a longer phrase takes a phrase's place.
MAX_WORDS, LEAST, LISTED, CONTAINED = 4, 30, 2000, 80
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that end a piece become line ends, tabs blanks, capitals small letters.
TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t" + UPPER.encode(), b"\n\n\n\n\n\n\n\n\n " + LOWER.encode())
GAP, WORD = re.compile(rb"[ \n]"), re.compile(rb"[ \n]*[^ \n]+")
#: Bytes of text in a slab, and suffixes in a block of the counting side.
SLAB, BLOCK = 4 << 20, 1 << 18

DEALT = "lang string, key binary, depth int, total bigint, rests binary, counts binary"


def cut(data: bytes, size: int) -> Iterator[tuple[int, bytes, int]]:
    """(offset, bytes, own): blocks that together have every word once before `own`; what follows are the next words, to complete suffixes."""
    at = 0
    while at < len(data):
        end = at + size
        found = GAP.search(data, end) if end < len(data) else None
        end = found.start() if found else len(data)
        stop = end
        for _ in range(MAX_WORDS - 1):
            following = WORD.match(data, stop)
            stop = following.end() if following else stop
        yield at, data[at:stop], end - at
        at = end


def numbered(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(different words in order, each word's number from 1, its line, its place) of bytes whose words stand between blanks and line ends."""
    b = np.frombuffer(data, np.uint8)
    inside = (b != 32) & (b != 10)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])]).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    codes = rank[words.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.empty(0, np.int64)
    return words.dictionary.take(pa.array(order)), codes, np.cumsum(b == 10)[starts] if len(starts) else codes, starts


def joined(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The words of the given numbers with blanks between them; number 0 is no word."""
    each = [words.take(pa.array(c - 1, mask=c == 0)) for c in columns]
    # rows without any word would be left out
    each[0] = pc.if_else(pa.array(np.all(np.array(columns) == 0, axis=0)), pa.scalar(b"", pa.binary()), each[0])
    return pc.binary_join_element_wise(*each, pa.scalar(b" ", pa.binary()), null_handling="skip")


class Suffixes:
    """The truncated suffixes of a block: different ones in order, with their counts."""

    def __init__(self, words: pa.Array, lang: np.ndarray, columns: list[np.ndarray], counts: np.ndarray | None = None, carried: list[np.ndarray] | None = None):
        self.words, self.width = words, len(words) + 1
        w = columns
        first, second = (lang * self.width + w[0]) * self.width + w[1], w[2] * self.width + w[3]
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(fresh)
        self.counts = np.add.reduceat(counts[order], at) if counts is not None and len(at) else np.diff(np.append(at, len(order)))
        self.lang, self.columns = lang[order][at], [c[order][at] for c in w]
        self.carried = [c[order][at] for c in carried or []]

    def keys(self, words: int) -> np.ndarray:
        """A number of each suffix's language and first one or two words."""
        one = self.lang * self.width + self.columns[0]
        return one if words == 1 else one * self.width + self.columns[1]

    def codes(self, phrase: bytes) -> list[int] | None:
        """The numbers of a phrase's words, None if one of them is not in the block."""
        found = pc.index_in(pa.array(phrase.split(b" "), pa.binary()), self.words).to_pylist()
        return None if None in found else [x + 1 for x in found]


def suffixes(words: pa.Array, codes: np.ndarray, lines: np.ndarray, lang: np.ndarray, own: int) -> Suffixes:
    """Suffixes of the first `own` words, each up to the end of its piece."""
    columns = [codes[:own]]
    for k in range(1, MAX_WORDS):
        follows = np.zeros(own, np.int64)
        n = max(0, min(own, len(codes) - k))
        follows[:n] = np.where(lines[k : k + n] == lines[:n], codes[k : k + n], 0)
        columns.append(follows)
    return Suffixes(words, lang[:own], columns)


def blocks(batches: Iterable[pa.RecordBatch], names: list[str], size: int) -> Iterator[Suffixes]:
    """Blocks of the texts in batches (lang, text); languages are numbered in `names`, which grows."""
    seen = {x: i for i, x in enumerate(names)}
    for b in text_slabs(batches, size):
        text = pc.cast(pc.fill_null(b.column("text"), ""), pa.binary())
        lengths = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths + 1)
        langs = []
        for x in b.column("lang").to_pylist():
            if x not in seen:
                seen[x] = len(names)
                names.append(x)
            langs.append(seen[x])
        data = b"\n".join(text.to_pylist()).translate(TABLE)
        for at, part, own in cut(data, size):
            words, codes, lines, places = numbered(part)
            if len(codes):
                lang = np.array(langs, np.int64)[np.searchsorted(ends, places + at, side="right")]
                yield suffixes(words, codes, lines, lang, int(np.searchsorted(places, own)))
            pa.default_memory_pool().release_unused()


def frequent_prefixes(batches: Iterable[pa.RecordBatch], share: float, size: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, prefix, n): the words of each language (words 0), and of each block the prefixes of up to three words that are more than `share` of it."""
    names: list[str] = []
    for s in blocks(batches, names, size):
        total = int(s.counts.sum())
        rows = [(names[i], 0, b"", int(n)) for i, n in enumerate(np.bincount(s.lang, s.counts).astype(np.int64)) if n]
        keep = np.ones(len(s.counts), bool)
        for n in range(1, MAX_WORDS):
            at = np.flatnonzero(keep & (s.columns[n - 1] > 0))
            if not len(at):
                break
            head = np.ones(len(at), bool)
            head[1:] = np.any([s.lang[at][1:] != s.lang[at][:-1], *[c[at][1:] != c[at][:-1] for c in s.columns[:n]]], axis=0)
            begin = np.flatnonzero(head)
            sums = np.add.reduceat(s.counts[at], begin)
            hot = sums > share * total
            text = joined(s.words, [c[at][begin][hot] for c in s.columns[:n]]).to_pylist()
            rows += [(names[i], n, t, int(c)) for i, t, c in zip(s.lang[at][begin][hot], text, sums[hot], strict=True)]
            keep = np.zeros(len(keep), bool)
            keep[at] = np.repeat(hot, np.diff(np.append(begin, len(at))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["lang", "words", "prefix", "n"])


def depths(s: Suffixes, names: list[str], hot: dict[str, list[bytes]]) -> np.ndarray:
    """Words of the prefix by which each suffix is dealt: the first prefix that is not frequent."""
    by = np.ones(len(s.counts), np.int64)
    known: list[set] = [set(), set(), set()]
    for i, name in enumerate(names):
        for phrase in hot.get(name, ()):
            codes = s.codes(phrase)
            if codes:
                known[len(codes) - 1].add((i, *codes))
    if not known[0]:
        return by
    by[np.isin(s.keys(1), [i * s.width + a for i, a in known[0]])] = 2
    pairs = np.array(sorted((i * s.width + a) * s.width + b for i, a, b in known[1]), np.int64)
    key = s.keys(2)
    by[np.isin(key, pairs)] = 3
    if known[2]:
        place = lambda k: np.searchsorted(pairs, k)
        triples = [int(place((i * s.width + a) * s.width + b)) * s.width + c for i, a, b, c in known[2]]
        at = np.flatnonzero(by == 3)
        by[at[np.isin(place(key[at]) * s.width + s.columns[2][at], triples)]] = 4
    return by


def dealt(batches: Iterable[pa.RecordBatch], hot: dict[str, list[bytes]], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each block's key: the rests of its suffixes, one a line, and their counts."""
    names: list[str] = []
    for s in blocks(batches, names, size):
        by = depths(s, names, hot)
        w = s.columns
        head = np.ones(len(by), bool)
        head[1:] = (s.keys(1)[1:] != s.keys(1)[:-1]) | np.any([(by[1:] > k) & (w[k][1:] != w[k][:-1]) for k in range(1, MAX_WORDS)], axis=0)
        begin = np.flatnonzero(head)
        bounds = np.append(begin, len(by)).astype(np.int32)
        rests = joined(s.words, [np.where(by > k, 0, w[k]) for k in range(1, MAX_WORDS)])
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), rests), pa.scalar(b"\n", pa.binary()))
        key = joined(s.words, [np.where(by[begin] > k, w[k][begin], 0) for k in range(MAX_WORDS)])
        counts = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(s.counts.astype(np.int32))])
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in s.lang[begin]], pa.string()), key, pa.array(by[begin].astype(np.int32)), pa.array(np.add.reduceat(s.counts, begin).astype(np.int64)), lines, counts], ["lang", "key", "depth", "total", "rests", "counts"])


def prefixes(rows: pa.Table, least: int) -> pa.RecordBatch | None:
    """(lang, phrase, words, f) of the prefixes in all rows of some keys: those with `least` occurrences, and parts of those that other keys have, too."""
    lang, key, counts = rows["lang"].combine_chunks().dictionary_encode(), rows["key"].to_pylist(), rows["counts"].to_pylist()
    n = np.array([len(c) // 4 for c in counts], np.int64)
    weights = np.frombuffer(b"".join(counts), np.int32).astype(np.int64)
    words, codes, line, _ = numbered(b"\n".join([*key, *rows["rests"].to_pylist()]))
    if not len(codes):
        return None
    slot = np.arange(len(line)) - np.searchsorted(line, line)
    heads = np.zeros((len(key), MAX_WORDS), np.int64)
    own = line < len(key)
    heads[line[own], slot[own]] = codes[own]
    of_row = np.repeat(np.arange(len(key)), n)
    table = heads[of_row]
    held = (heads > 0).sum(axis=1)
    at = line[~own] - len(key)
    table[at, slot[~own] + held[of_row][at]] = codes[~own]
    depth = rows["depth"].to_numpy().astype(np.int64)[of_row]
    s = Suffixes(words, lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of_row], list(table.T), weights, [depth])
    # reverse order: what a prefix has in common with the suffix before it ends where it is complete
    w, langs, depth = [c[::-1] for c in s.columns], s.lang[::-1], s.carried[0][::-1]
    sums = np.concatenate([[0], np.cumsum(s.counts[::-1])])
    changed = np.ones(len(depth), bool)
    changed[1:] = langs[1:] != langs[:-1]
    out = []
    for k in range(MAX_WORDS):
        changed[1:] |= w[k][1:] != w[k][:-1]
        begin = np.flatnonzero(changed)
        f = sums[np.append(begin[1:], len(depth))] - sums[begin]
        good = (w[k][begin] > 0) & ((f >= least) | (depth[begin] > k + 1))
        out.append((langs[begin][good], joined(words, [c[begin][good] for c in w[: k + 1]]), np.full(int(good.sum()), k + 1, np.int32), f[good]))
    names = lang.dictionary.take(pa.array(np.concatenate([o[0] for o in out])))
    return pa.RecordBatch.from_arrays([names, pc.cast(pa.concat_arrays([o[1] for o in out]), pa.string()), pa.array(np.concatenate([o[2] for o in out])), pa.array(np.concatenate([o[3] for o in out]))], ["lang", "phrase", "words", "f"])


def counted(batches: Iterable[pa.RecordBatch], least: int, block: int) -> Iterator[pa.RecordBatch]:
    """The prefixes of sorted rows, in blocks of whole keys with about `block` suffixes."""
    held: list[pa.Table] = []
    size = 0

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        # a key that is rare as a whole and is dealt by one word has no frequent prefix; one dealt by more words only has its part in shorter ones
        ident = pa.table({"k": pc.binary_join_element_wise(pc.cast(rows["lang"], pa.binary()), rows["key"], pa.scalar(b"\n", pa.binary()))})["k"].combine_chunks().dictionary_encode()
        ident = ident.indices.to_numpy(zero_copy_only=False)
        rare = np.bincount(ident, rows["total"].to_numpy())[ident] < least
        depth = rows["depth"].to_numpy()
        full = rows.filter(pa.array(~rare))
        if full.num_rows and (got := prefixes(full, least)) is not None and got.num_rows:
            yield got
        if (rare & (depth > 1)).any():
            part = rows.filter(pa.array(rare & (depth > 1)))
            alone = part.set_column(4, "rests", pa.array([b""] * part.num_rows, pa.binary())).set_column(5, "counts", pa.array([np.int32(t).tobytes() for t in part["total"].to_pylist()], pa.binary()))
            if (got := prefixes(alone, least)) is not None and got.num_rows:
                yield got

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        size += pc.sum(pc.binary_length(b.column("counts"))).as_py() // 4 if b.num_rows else 0
        if size >= block:
            rows = pa.concat_tables(held)
            last, n = rows.slice(rows.num_rows - 1), rows.num_rows
            same = pc.and_(pc.equal(rows["lang"], last["lang"][0]), pc.equal(rows["key"], last["key"][0])).to_numpy()
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield from of(rows.slice(0, whole))
            # a copy, or the slice would hold all rows of the block
            held = [rows.take(pa.array(np.arange(whole, n)))]
            size = pc.sum(pc.binary_length(held[0]["counts"])).as_py() // 4
            pa.default_memory_pool().release_unused()
    if held and sum(t.num_rows for t in held):
        yield from of(pa.concat_tables(held))


def phrase_counts(docs: DataFrame, least: int = LEAST, parts: int | None = None, slab: int = SLAB, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f of all phrases of one to MAX_WORDS words with `least` occurrences; lang, n of the words of each language).

    A prefix with more than one in `parts` of all words is split; fewer than 6 * parts prefixes are, and only they reach the driver.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    share = 1 / (2 * parts)  # a prefix with twice that share of all words has half of it at least in blocks where it has this share
    seen = written(rows.mapInArrow(lambda x: frequent_prefixes(x, share, slab), "lang string, words int, prefix binary, n bigint").groupBy("lang", "words", "prefix").agg(F.sum("n").alias("n")), "prefixes")
    sizes = seen.filter("words = 0").select("lang", "n")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot: dict[str, list[bytes]] = {}
    for r in seen.filter((F.col("words") > 0) & (F.col("n") > share * total)).select("lang", "prefix").collect():
        hot.setdefault(r["lang"], []).append(bytes(r["prefix"]))
    sent = rows.mapInArrow(lambda x: dealt(x, hot, slab), DEALT).repartition(parts, "lang", "key").sortWithinPartitions("lang", "key")
    f = sent.mapInArrow(lambda x: counted(x, least, block), "lang string, phrase string, words int, f bigint").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return written(f.filter(F.col("f") >= least), "phrases"), sizes


def collocations(docs: DataFrame, least: int = LEAST, listed: int = LISTED, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `listed` best phrases.

    Texts are read whole, a null or empty one has no words; a null language is `und`; repeated rows count as often as they come; ties in
    the score go by occurrences, then by the phrase's bytes, so the order is fixed; other columns are ignored, and an empty table
    gives no rows.  Words are told apart by their bytes; arithmetic is exact.  A text of any length is taken in blocks.
    """
    f, sizes = phrase_counts(docs, least, **how)
    words = F.split("phrase", " ")
    part = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    candidates = f.filter("words > 1")
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    piece = lambda c, n: f.select("lang", F.col("phrase").alias(c), F.col("f").alias(n))
    scored = cuts.join(piece("first", "l"), ["lang", "first"]).join(piece("rest", "r"), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    scored = scored.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = f.filter("words > 2").select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))")).alias("phrase"))
    outer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_outer"))
    kept = best.join(outer, ["lang", "phrase"], "left").filter(F.col("_outer").isNull() | (exact("_outer") * 100 < exact("a") * CONTAINED))
    rows = kept.join(sizes, "lang").select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a language's phrases are thinned out in parts before they meet
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= listed)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= listed)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k AS words, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM i, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k) AS ks WHERE i + k - 1 <= len(ws)),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
f AS (SELECT lang, phrase, words, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, phrase, f AS a, words, string_split(phrase, ' ') AS ws, unnest(range(1, words)) AS k FROM f WHERE words > 1),
s AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS BIGINT) AS score FROM c JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s) AS x WHERE nth = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f AS o WHERE o.lang = b.lang AND o.words > len(string_split(b.phrase, ' ')) AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * CAST(o.f AS HUGEINT) >= {CONTAINED} * CAST(a AS HUGEINT)))
SELECT lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM d) AS q JOIN n USING (lang) WHERE rank <= {LISTED}
"""
