"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Slices come from the transition-function scan of `textscan`.  Equal slices of
a batch are found by two 64-bit hashes over prefix sums; each distinct slice is
merged once and its ids are kept in a bounded cache.  Ids, and on decoding the
tokens' bytes, are gathered by offsets.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slabs, texts_of
from .textscan import SCAN_CHARS, Scan, groups
from .vocab import load

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct slices kept per process; then the cache starts anew.
CACHE_WORDS = 200_000
#: Longer slices are merged without being kept.
CACHE_BYTES = 64
BASE = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))


@lru_cache(maxsize=1)
def _powers() -> list[list[np.ndarray]]:
    """[base powers, powers of its inverse mod 2**64] for both bases; grows by need."""
    return [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in BASE]


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers()[k]
    if len(have[0]) < n:
        for side, base in enumerate((BASE[k], np.uint64(pow(int(BASE[k]), -1, 1 << 64)))):
            x = np.full(max(n, 1 << 21), base, np.uint64)
            x[0] = 1
            have[side] = np.cumprod(x, dtype=np.uint64)
    return have[0], have[1]


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def slice_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every slice, from one prefix sum over the data."""
    up, down = powers(k, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes()[k][data] * up[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h ^= h >> np.uint64(32)
    return h * BASE[1 - k] + (end - start).astype(np.uint64)


def ragged(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions offset[i] .. offset[i] + length[i] - 1, one run after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(offset - (ends - length), length)


def classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of one member of each class of equal keys, class of each key)."""
    order = np.argsort(keys)
    inner = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = inner[1:] != inner[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class Codec:
    def __init__(self, name: str):
        self.vocab = load(name)
        size = self.vocab.size
        self.length = np.zeros(size, np.int64)
        for k, t in self.vocab.tokens.items():
            self.length[k] = len(t)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.vocab.tokens.get(k, b"") for k in range(size)), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, list[int]] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        for a, b in groups(texts, 2 * SCAN_CHARS):
            out += self._encode(texts[a:b])
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        scan = Scan(texts)
        if not len(scan.start):
            return [np.zeros(0, "<u4") for _ in texts]
        one = slice_hash(scan.data, scan.start, scan.end, 0)
        first, which = classes(one)
        two = slice_hash(scan.data, scan.start, scan.end, 1)
        if not np.array_equal(two, two[first][which]):  # two slices share a hash: take all slices one by one
            first = which = np.arange(len(one))
        raw, merged = scan.data.tobytes(), []
        known, merge = self.known, self.vocab.merge
        for s, e in zip(scan.start[first].tolist(), scan.end[first].tolist(), strict=True):
            word = raw[s:e]
            ids = known.get(word)
            if ids is None:
                ids = merge(word)
                if len(word) <= CACHE_BYTES:
                    known[word] = ids
            merged.append(ids)
        if len(known) > CACHE_WORDS:
            self._clear()
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter(chain.from_iterable(merged), "<u4", int(sizes.sum()))
        count = sizes[which]
        ids = flat[ragged((np.cumsum(sizes) - sizes)[which], count)]
        per = np.bincount(scan.doc, weights=count, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: token offsets into one array of all tokens' bytes."""
        ids = ids.astype(np.int64)
        return self.bytes[ragged(self.offset[ids], self.length[ids])].tobytes()


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    return Codec(name)


def encode_documents(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, ids array<int> of every row's whole text; null texts have no ids, an empty table gives no rows."""

    def run(batches):
        for b in slabs(batches):
            ids = codec(name).encode(texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, data binary from doc_id, ids; null ids decode to no bytes."""

    def run(batches):
        for b in slabs(batches):
            got = [codec(name).decode(np.asarray(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def digests(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, without moving ids between processes.

    Null texts count as empty; texts of any length are encoded whole; repeated
    rows each give a row, a null doc_id stays null; an empty table gives none;
    other columns are ignored.
    """

    def run(batches):
        c = codec(name)
        for b in slabs(batches):
            ids = c.encode(texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
