"""Token counts by a finite-state tokenizer.

Two transducers: the pre-tokenizer's (textscan), whose chunk state maps are
composed by an associative prefix scan, and the vocabulary's (transducer),
whose transitions carry counts of emitted tokens.  The latter starts anew at
every pre-token, so chunk maps of short ones are plain counts, which add up;
long ones are cut into chunks whose maps compose.  Special strings count as one
token each, as the library handles them by default.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slabs, texts_of
from .textscan import Scan, groups
from .transducer import transducer
from .vocab import load

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512


def split_special(texts: list[str], special: dict[str, int]) -> tuple[list[str], list[int], np.ndarray]:
    """(ordinary pieces, index of each one's text, special strings per text)."""
    found = np.zeros(len(texts), np.int64)
    pieces, owner = [], []
    cut = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
    for i, t in enumerate(texts):
        parts = cut.split(t) if cut and any(x in t for x in special) else [t]
        found[i] = len(parts) - 1
        pieces += parts
        owner += [i] * len(parts)
    return pieces, owner, found


def count_texts(texts: list[str], name: str = VOCABULARY) -> np.ndarray:
    machine, (pieces, owner, out) = transducer(name), split_special(texts, load(name).special)
    for a, b in groups(pieces):
        scan = Scan(pieces[a:b])
        if len(scan.doc):
            per = np.bincount(scan.doc, weights=machine.count(scan), minlength=b - a).astype(np.int64)
            np.add.at(out, owner[a:b], per)
    return out


def token_counts(docs: DataFrame, limit: int = LIMIT, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null texts count as empty (0 bytes, 0 tokens); texts of any length are
    counted whole; repeated rows each give a row, a null doc_id stays null; an
    empty table gives none; other columns are ignored.
    """

    def run(batches):
        for b in slabs(batches):
            texts = texts_of(b.column(1))
            n = count_texts(texts, name)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
