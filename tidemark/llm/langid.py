"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1.  For every bit a binary linear classifier on
hashed character 1- to 3-grams is fitted (regularised least squares on at most
PER_LANGUAGE labelled texts of each language, a documented bound).  Decoding
adds up each bit's exponential loss, weighted by how often that bit's
classifier is right about texts of the language that it was not fitted on
(leave-one-out, in closed form), and takes the codeword with the least loss; a
small lead over the second flags the text as ambiguous.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slabs, texts_of
from .textscan import LETTER, codepoint_classes, groups

DIM, PER_LANGUAGE, FOLDS, UNKNOWN = 4096, 500, 5, "und"
#: Least lead of the best probability over the second.
AMBIGUOUS = 0.05
#: An ambiguous text with less than this for its best language fits none; a mix of two has almost half for each.
FITS_NONE = 0.4


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length over DIM hashed n-grams of lower-cased letters, which texts have letters)."""
    rows, letters = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    for a, b in groups(texts):
        low = [t.lower() for t in texts[a:b]]
        sizes = np.fromiter(map(len, low), np.int64, b - a)
        cps = np.frombuffer(" ".join(low).encode("utf-32-le"), np.uint32)
        if not len(cps):
            continue
        doc = np.repeat(np.arange(b - a), sizes + 1)[: len(cps)]
        is_letter = codepoint_classes()[cps] == LETTER
        c = np.where(is_letter, cps, 32).astype(np.uint64)
        letters[a:b] = np.bincount(doc[is_letter], minlength=b - a) > 0
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # one blank after a word
        c, doc = c[keep], doc[keep]
        h, cells = np.zeros(len(c), np.uint64), np.zeros((b - a) * DIM)
        for n in range(3):
            h = (h[: len(c) - n] * np.uint64(0x9E3779B97F4A7C15) + c[n:] + np.uint64(n + 1)) if n else c * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
            if not len(h):
                break
            h = h ^ (h >> np.uint64(29))
            bucket = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)).astype(np.int64)
            inside = doc[: len(h)] == doc[n:]
            cells += np.bincount((doc[: len(h)] * DIM + bucket)[inside], minlength=len(cells))
        counts = np.sqrt(cells.reshape(b - a, DIM))
        rows[a:b] = counts / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1e-9)
    return rows, letters


def packed(row: np.ndarray) -> bytes:
    """The places of a row's values that are not zero, then these values."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes()


def unpack(data: bytes, row: np.ndarray) -> None:
    n = len(data) // 6
    row[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)


def codebook(languages: int) -> np.ndarray:
    """Codewords in rows: exhaustive for up to 5 languages, else the random code of 50 with the largest least distance."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        columns = [c for c in product((1, -1), repeat=languages) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    rng, bits, best = np.random.default_rng(11), int(np.ceil(10 * np.log2(languages))), None
    for _ in range(50):
        code = rng.choice(np.array([1, -1], np.int8), (languages, bits))
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + 10 * bits * np.eye(languages, dtype=int)
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def inverted(a: np.ndarray, block: int = 256) -> np.ndarray:
    """The inverse of a symmetric positive definite matrix, in its own place: elimination by blocks, without a second matrix."""
    for k in range(0, len(a), block):
        own = slice(k, min(k + block, len(a)))
        pivot = np.linalg.inv(a[own, own])
        row = pivot @ a[own]
        for r in range(0, len(a), block):
            if r != k:
                other = slice(r, min(r + block, len(a)))
                left = a[other, own].copy()
                a[other] -= left @ row
                a[other, own] = -left @ pivot
        a[own] = row
        a[own, own] = pivot
    return a


class Model:
    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, ridge: float = 0.05):
        self.languages, self.code = languages, codebook(len(languages))
        if len(languages) < 2:
            self.weights, self.bias, self.trust = np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32), np.ones((len(languages), 1))
            return
        target = self.code[y].astype(np.float64)
        share = 1 / np.bincount(y, minlength=len(languages))[y]
        root = np.sqrt(share * len(languages) / share.sum() * len(y) / len(languages))[:, None]  # languages weigh the same
        left_out = self._of_rows(x, target * root, root, ridge) if len(x) <= DIM else self._of_features(x, target * root, root, ridge)
        right = (left_out * target > 0).astype(float)
        trust = np.array([right[y == k].mean(axis=0) for k in range(len(languages))]) + 1e-3
        self.trust = trust / trust.sum(axis=1, keepdims=True)

    def _of_rows(self, x: np.ndarray, wanted: np.ndarray, root: np.ndarray, ridge: float) -> np.ndarray:
        """Fits by the kernel of the rows, the smaller matrix for few of them; gives each row's value from a fit without it."""
        kernel = (x @ x.T).astype(np.float64)
        kernel += 1
        kernel *= root
        kernel *= root.T
        kernel[np.diag_indices_from(kernel)] += ridge
        inverse = inverted(kernel)
        dual = inverse @ wanted
        left_out = wanted - dual / np.diag(inverse)[:, None]
        dual *= root
        self.weights, self.bias = x.T @ dual.astype(np.float32), dual.sum(axis=0).astype(np.float32)
        return left_out

    def _of_features(self, x: np.ndarray, wanted: np.ndarray, root: np.ndarray, ridge: float) -> np.ndarray:
        """The same by the matrix of the features, whose size does not grow with the languages."""
        rows = np.hstack([x, np.ones((len(x), 1), np.float32)]) * root.astype(np.float32)
        square = (rows.T @ rows).astype(np.float64)
        square[np.diag_indices_from(square)] += ridge
        inverse = inverted(square)
        weights = inverse @ (rows.T @ wanted)
        own = np.einsum("nd,nd->n", rows @ inverse.astype(np.float32), rows)[:, None]
        self.weights, self.bias = weights[:-1].astype(np.float32), weights[-1].astype(np.float32)
        return wanted - (wanted - rows @ weights) / np.maximum(1 - own, 1e-6)

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Probability of each language from the loss-weighted distance to its codeword."""
        margin = np.clip(rows @ self.weights + self.bias, -3, 3)
        loss = np.einsum("lb,nlb->nl", self.trust, np.exp(-margin[:, None, :] * self.code[None, :, :]))
        odds = np.exp(-3 * (loss - loss.min(axis=1, keepdims=True)))
        return odds / odds.sum(axis=1, keepdims=True)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder; a missing id is an empty text, hence held out, and nothing is learnt from it."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From text and non-null lang of documents that are not held out; of each language the per_language rows with the smallest hash of doc_id."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = F.lit(False)
    for r in counts:  # about twice per_language rows of each language are ranked, not all
        near = near | ((F.col("lang") == r["lang"]) & (draw < int(min(1.0, 2 * per_language / r["n"] + 20 / r["n"]) * (1 << 30))))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    chosen = labelled.filter(near).select("lang", "text", "doc_id", draw.alias("draw")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_language)

    def run(batches):
        for b in slabs(batches, 256):
            rows, letters = features(texts_of(b.column(1)))
            keep = np.flatnonzero(letters)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([packed(rows[i]) for i in keep], pa.binary())], ["lang", "row"])

    got = chosen.select("lang", "text").mapInArrow(run, "lang string, row binary").orderBy("lang", "row").toArrow()
    names = got.column(0).to_pylist()
    languages = sorted(set(names))
    x = np.zeros((len(names), DIM), np.float32)
    for row, data in zip(x, got.column(1), strict=True):
        unpack(data.as_py(), row)
    del got
    return Model(languages, x, np.array([languages.index(n) for n in names], np.int64))


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, whether ambiguous) of each text."""
    rows, letters = features(texts)
    if not model.languages:
        letters[:] = False
    odds = model.decode(rows) if model.languages else np.zeros((len(rows), 1))
    p, best = np.sort(odds, axis=1), odds.argmax(axis=1)
    lead = p[:, -1] - (p[:, -2] if p.shape[1] > 1 else 0)
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], np.where(letters, p[:, -1], 0.0), ~letters | (lead < AMBIGUOUS)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row, from the text alone.

    A null text, or one without a letter, is `und` with score 0 and ambiguous;
    so is every text if no language was learnt.  Of equal probabilities the
    language that comes first by name is taken.  Texts are read whole; repeated
    rows each give a row, a null doc_id stays null; an empty table gives none;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slabs(batches, 256):
            lang, score, ambiguous = predict(shared.value, texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, but for texts without a letter and texts that fit no learnt language; nothing is shuffled."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in slabs(batches, 256):
            lang, score, ambiguous = predict(shared.value, texts_of(b.column(at)))
            fits = np.array([x != UNKNOWN for x in lang], bool) & ~(ambiguous & (score < FITS_NONE))
            yield b.filter(pa.array(fits, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
