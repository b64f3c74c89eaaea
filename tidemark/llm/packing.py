"""Packing token sequences by a configuration linear program.

Pieces are at most `capacity` tokens, so their lengths form a histogram of bounded
size.  A configuration is a multiset of lengths that fits a sequence; the
program asks for the fewest sequences that cover the histogram.
It is solved by multiplicative weights: every length has a price, which falls by a
factor each time the length is covered, so lengths that lag behind become dear.
Knapsack dynamic programming finds the configurations of the highest price; the
prices divided by that price are a solution of the dual program, so each round
also gives a lower bound, and the rounds end when cover and bound are close.
The fractional solution covers some lengths more than once, so it is rounded down
at three scales (so that the least, the mean or the most covered length is met
once); what rounding leaves over goes by best fit decreasing, and the scale with
the fewest sequences is taken.
All of this is in counts: its cost does not depend on the number of documents.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpecodec import codec
from .common import slabs, texts_of, written
from .vocab import _file, load

CAPACITY, END = 1024, 2
#: Rows are numbered in shares of about this many, so a frequent length is no single task.
SHARE_ROWS = 1 << 14
#: Step of the prices, rounds at most, and the gap between cover and bound at which they end.
STEP, ROUNDS, GAP = 0.1, 120, 0.002


@lru_cache(maxsize=2)
def encoder(name: str):
    """The vocabulary's encoder: a .json vocabulary of the same ranks is read from its .tiktoken twin, which is several times faster and gives the same ids (tested)."""
    import public_tokenizers
    import tiktoken

    with open(_file(name.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=load(name).special)


def ids_of(name: str, text: str) -> np.ndarray:
    """Ids of a text, special strings as their ids.  The library gives up on some very long runs of white space; these texts are scanned without a pattern engine."""
    try:
        return encoder(name).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        special = load(name).special
        parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text) if special else [text]
        return np.concatenate([np.array([special[p]], np.uint32) if k % 2 else codec(name).encode([p])[0] for k, p in enumerate(parts)])


def token_pieces(docs: DataFrame, name: str, capacity: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and the end id; only longer documents are cut, the first piece takes the odd rest."""

    def run(batches):
        for b in slabs(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                ids = np.append(ids_of(name, text), np.uint32(end)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for column, value in zip(out, (doc, piece, x, y - x, zlib.crc32(ids[x:y].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best price of a content of each size, index of the item taken last, -1 for an unused unit)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = int(np.searchsorted(lengths, c, side="right"))
        if k:
            value = best[c - lengths[:k]] + price[:k]
            j = int(value.argmax())
            if value[j] > best[c]:
                best[c], take[c] = value[j], j
    return best, take


def configuration(lengths: np.ndarray, take: np.ndarray, room: int, first: int) -> dict[int, int]:
    out = {first: 1}
    room -= int(lengths[first])
    while room > 0:
        j = int(take[room])
        if j < 0:
            room -= 1
        else:
            out[j] = out.get(j, 0) + 1
            room -= int(lengths[j])
    return out


def covering(lengths: np.ndarray, need: np.ndarray, capacity: int, step: float = STEP, rounds: int = ROUNDS, gap: float = GAP) -> tuple[dict[tuple, float], float, tuple[float, float]]:
    """(multiplicities of configurations, sorted (index, copies) pairs, that cover `need`; a lower bound on the sequences of any cover; mean and largest coverage)."""
    price = lengths / capacity  # at these prices the bound is the volume
    cover, times, bound = np.zeros(len(lengths)), {}, 0.0
    for _ in range(rounds):
        best, take = knapsack(lengths, price, capacity)
        top = best[capacity]
        bound = max(bound, float(need @ price) / top)
        value = price + best[capacity - lengths]
        for j in np.argsort(cover, kind="stable").tolist():
            if value[j] < (1 - step) * top:
                continue
            found = configuration(lengths, take, capacity, j)
            at, copies = np.array(list(found)), np.array(list(found.values()))
            if copies @ price[at] < (1 - step) * top:
                continue  # prices have fallen since
            rate = copies / need[at]
            once = 1 / rate.max()
            cover[at] += rate * once
            price[at] *= np.exp(-step * rate * once)
            key = tuple(sorted(found.items()))
            times[key] = times.get(key, 0.0) + once
        price /= price.max()
        if cover.min() > 0 and sum(times.values()) / cover.min() <= bound * (1 + gap):
            break
    least = cover[cover > 0].min()
    for j in np.flatnonzero(cover == 0).tolist():  # a length that no round reached
        times[((j, 1),)], cover[j] = float(need[j]) * least, least
    volume = lengths * need
    return {key: n / least for key, n in times.items()}, bound, (float(cover @ volume) / float(volume.sum()) / least, float(cover.max()) / least)


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: bins of equal content move together."""
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for j in np.argsort(-lengths, kind="stable").tolist():
        size, left = int(lengths[j]), int(counts[j])
        while left:
            room = next((f for f in range(size, capacity + 1) if open_[f]), None)
            if room is None:
                each = capacity // size
                for copies, bins in ((each, left // each), (left % each, 1)):
                    if copies and bins:
                        key = (size,) * copies
                        at = open_[capacity - size * copies]
                        at[key] = at.get(key, 0) + bins
                left = 0
            else:
                key, bins = open_[room].popitem()
                used = min(bins, left)
                if bins > used:
                    open_[room][key] = bins - used
                at = open_[room - size]
                at[(*key, size)] = at.get((*key, size), 0) + used
                left -= used
    return [(k, n) for at in open_ for k, n in at.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) that together hold exactly the histogram."""
    full = histogram.get(capacity, 0)
    items = sorted((k, n) for k, n in histogram.items() if k < capacity and n)
    out = [((capacity,), full)] if full else []
    if not items:
        return out
    lengths, need = np.array([k for k, _ in items]), np.array([n for _, n in items])
    times, _, scales = covering(lengths, need, capacity)
    return out + min((rounded(lengths, need, times, scale, capacity) for scale in (1.0, *scales)), key=lambda found: sum(n for _, n in found))


def rounded(lengths: np.ndarray, need: np.ndarray, times: dict[tuple, float], scale: float, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The configurations, each as often as its multiplicity over `scale` rounded down and as what is left allows; then the rest by best fit."""
    rest, out = need.copy(), []
    for key, often in sorted(times.items(), key=lambda x: -x[1]):
        n = min([math.floor(often / scale), *(int(rest[i]) // k for i, k in key)])
        if n > 0:
            for i, k in key:
                rest[i] -= n * k
            out.append((tuple(int(lengths[i]) for i, k in reversed(key) for _ in range(k)), n))
    return out + best_fit(lengths, rest, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns, among them doc_id, piece, length, ids_crc32), a table that can be read again.

    Pieces of one length are numbered by shares, whose number grows with the
    rows; the histogram, of `capacity` rows at most, is all that the driver gets,
    and the plan made of it all that is broadcast.
    """
    spark, shares = pieces.sparkSession, -(-pieces.count() // SHARE_ROWS) or 1
    salted = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)).cast("int"))
    counts = written(salted.groupBy("length", "share").agg(F.count("*").alias("n")), "shares")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow().to_pylist()}
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "share", F.coalesce(earlier, F.lit(0)).alias("before"))
    rank0, first_seq, copies, first_off = {}, {}, {}, {}
    base = 0
    for content, n in plan(histogram, capacity):
        off = 0
        for size in dict.fromkeys(content):
            k = content.count(size)
            ranks = rank0.setdefault(size, [0])
            first_seq.setdefault(size, []).append(base)
            copies.setdefault(size, []).append(k)
            first_off.setdefault(size, []).append(off)
            ranks.append(ranks[-1] + k * n)
            off += k * size
        base += n
    shared = spark.sparkContext.broadcast({size: tuple(map(np.array, (rank0[size], first_seq[size], copies[size], first_off[size]))) for size in histogram})
    number = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1
    names = pieces.columns

    def run(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                ranks, first, k, o = shared.value[size]
                j = np.searchsorted(ranks, rank[at], side="right") - 1
                inner = rank[at] - ranks[j]
                seq[at], off[at] = first[j] + inner // k[j], o[j] + inner % k[j] * size
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    ranked = salted.withColumn("nth", number).join(starts, ["length", "share"]).select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, name: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null texts count as empty and give one piece with the end id; repeated rows
    are packed once each (which of two equal rows comes first is all that ties
    leave open); a null doc_id stays null; texts of any length are cut, not
    shortened; an empty table gives no rows; other columns are ignored.
    """
    return pack(written(token_pieces(docs, name, capacity, end), "pieces"), capacity)
