"""Quality rules on repetition: a suffix array of each text's words, and the repeated passages that its LCP intervals hold.

The texts of a slab share one suffix array: words are numbered, a suffix ends with its text, and prefix doubling sorts on only those
suffixes that still tie.  The ranks of every round are kept, so that the common prefix of two neighbours is
read from them in as many steps as there were rounds.  The deepest LCP interval that holds a suffix has
the larger of its two neighbouring common prefixes as its value: the longest passage from there that occurs elsewhere, too.  The
union of these spans is what repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slabs, texts_of

#: Words of a repeated window of the base rule, and the rule itself: texts with fewer words or with a larger share of words in such windows fail (fixed values).
WINDOW, LEAST_WORDS, BASE_PERCENT = 8, 20, 30
#: The verdict: repeated passages count from PASSAGE words on and may cover COVERED_PERCENT of the words; none may be longer than LONGEST words;
#: there may be SYMBOL_PERCENT symbols for a hundred words, and LINE_PERCENT of the lines with words may repeat an earlier one.
PASSAGE, COVERED_PERCENT, LONGEST, SYMBOL_PERCENT, LINE_PERCENT = 4, 30, 60, 10, 50
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Bytes of text in a slab; a longer text is a slab of its own.
SLAB = 4 << 20

SCHEMA = "doc_id {id}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_covered bigint, longest_repeat bigint, base_failed boolean, kept boolean"


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words in a row, equal for equal words, and how many words each text has."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at ASCII white space only
    counts = np.array([len(s) for s in split], np.int64)
    words = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def doubling(codes: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks of each round): round k ranks suffixes by their first 2**k words, equal ranks for ties.

    owner: the text of each word; ends: where that text ends.  Suffixes are ordered by text first, so that no
    passage is shared by two.
    """
    n = len(codes)
    key = owner * (codes.max(initial=0) + 1) + codes
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    ranks = []
    slots = np.arange(n)  # places in the order that are in a tie
    heads = np.maximum.accumulate(np.where(fresh, slots, 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = heads
    h = 1
    while n:
        ranks.append(rank.astype(np.int32))
        same = rank[order[slots]]
        tied = np.zeros(len(slots), bool)
        tied[1:] = same[1:] == same[:-1]
        tied[:-1] |= same[:-1] == same[1:]
        slots = slots[tied]
        if not len(slots):
            break
        at = order[slots]
        after = np.where(at + h < ends[at], rank[np.minimum(at + h, n)], -1) + 1
        by = rank[at] * (n + 1) + after
        sort = np.argsort(by, kind="stable")
        order[slots], by = at[sort], by[sort]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = by[1:] != by[:-1]
        rank = rank.copy()
        rank[order[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2
    return order, ranks


def longest_repeats(codes: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word the length of the longest passage from it that occurs at another place of its text, too; 0 if there is none."""
    n = len(codes)
    order, ranks = doubling(codes, ends, owner)
    common = np.zeros(n + 1, np.int64)
    pairs = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) if n else np.empty(0, np.int64)
    a, b = order[pairs].copy(), order[pairs + 1].copy()
    length = np.zeros(len(pairs), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        equal = ranks[k][np.minimum(a, n)] == ranks[k][np.minimum(b, n)]
        step = equal.astype(np.int64) << k
        a, b, length = a + step, b + step, length + step
    common[pairs + 1] = length  # between the place before and this one
    out = np.empty(n, np.int64)
    out[order] = np.maximum(common[:-1], common[1:])
    return out


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Words inside a repeated passage of `least` words or more: the union of the spans."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    edges = np.bincount(at, minlength=n + 1) - np.bincount(at + lengths[at], minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def measures(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts of each text."""
    codes, n_words = words_of(texts)
    starts = np.concatenate([[0], np.cumsum(n_words)])
    owner = np.repeat(np.arange(len(texts)), n_words)
    lengths = longest_repeats(codes, starts[1:][owner], owner)
    of_text = lambda mask: np.bincount(owner[mask], minlength=len(texts))
    longest = np.zeros(len(texts), np.int64)
    some = n_words > 0
    if some.any():
        longest[some] = np.maximum.reduceat(lengths, starts[:-1][some])
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    white = str.maketrans("", "", WHITE.decode())
    lines = [[x for x in t.split("\n") if x.translate(white)] for t in texts]
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t) - len(b) + len(b.translate(None, WHITE)) for t, b in zip(texts, raw, strict=True)], np.int64),
        "n_symbols": np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": of_text(covered(lengths, WINDOW)),
        "n_lines": np.array([len(x) for x in lines], np.int64),
        "n_covered": of_text(covered(lengths, PASSAGE)),
        "longest_repeat": longest,
    }


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept), in whole numbers."""
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    bad = (100 * m["n_covered"] > COVERED_PERCENT * m["n_words"]) | (m["longest_repeat"] > LONGEST) | (100 * m["n_symbols"] > SYMBOL_PERCENT * m["n_words"]) | (100 * m["n_dup_lines"] > LINE_PERCENT * m["n_lines"])
    return failed, ~failed & ~bad


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row.

    A null or empty text has no words and fails the base rule; texts are read whole, however long, and a long one is a suffix array of its own.
    Each row is judged alone: repeated rows, ties and rows without a doc_id have a row each; other columns are
    ignored; an empty table gives no rows.  n_repeat_words counts the words in windows of WINDOW words that occur twice or more, n_covered
    those in passages of PASSAGE words or more, and longest_repeat is the longest passage that occurs twice, overlaps
    included.
    """
    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slabs(batches, SLAB):
            m = measures(texts_of(b.column("text")))
            failed, kept = verdicts(m)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, pa.int64()) for v in m.values()], pa.array(failed), pa.array(kept)], ["doc_id", *m, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def spans(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """doc_id, start, length (in words): the disjoint runs of each text's words that repeated passages of `least` words or more cover."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slabs(batches, SLAB):
            codes, n_words = words_of(texts_of(b.column("text")))
            starts = np.concatenate([[0], np.cumsum(n_words)])
            owner = np.repeat(np.arange(len(n_words)), n_words)
            inside = covered(longest_repeats(codes, starts[1:][owner], owner), least)
            first = inside & ~(np.concatenate([[False], inside[:-1]]) & (np.concatenate([[-1], owner[:-1]]) == owner))
            run_of = np.cumsum(first)[inside] - 1
            begins = np.flatnonzero(first)
            at = owner[begins]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(begins - starts[at]), pa.array(np.bincount(run_of, minlength=len(begins)).astype(np.int64))], ["doc_id", "start", "length"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, length bigint")


def _repeated(size: str, name: str) -> str:
    """Words of each text in windows of so many words that occur twice or more."""
    return f"""{name}_w AS (SELECT r, i, md5(array_to_string(w[i + 1:i + {size}], ' ')) AS k FROM (SELECT r, w, unnest(range(0, len(w) - {size} + 1)) AS i FROM t WHERE len(w) >= {size})),
{name}_s AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS b FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM {name}_w) WHERE c > 1),
{name} AS (SELECT r, CAST(sum(CASE WHEN b IS NULL THEN {size} ELSE least({size}, i - b) END) AS BIGINT) AS n FROM {name}_s GROUP BY r)"""


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
{_repeated(str(WINDOW), "win")},
{_repeated(str(PASSAGE), "pas")},
{_repeated(str(LONGEST + 1), "lon")},
c AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(win.n, 0) AS n_repeat_words, len(l) AS lines, coalesce(pas.n, 0) AS cov, lon.n IS NOT NULL AS long FROM t LEFT JOIN win USING (r) LEFT JOIN pas USING (r) LEFT JOIN lon USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * cov > {COVERED_PERCENT} * n_words OR long OR 100 * n_symbols > {SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {LINE_PERCENT} * lines) AS kept FROM b
"""
