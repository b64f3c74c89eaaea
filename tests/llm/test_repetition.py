"""Quality rules against brute force and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

from tidemark.llm import repetition

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, kept string, n_words int"


def inside(words, size):
    """Words in windows that occur twice or more."""
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    n = Counter(windows)
    return {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(size)}


def brute(text):
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    longest = max((s for s in range(1, len(words)) if inside(words, s)), default=0)
    n = len(words)
    out = [n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside(words, 8))]
    failed = n < 20 or 100 * out[4] > 30 * n
    kept = not failed and 100 * len(inside(words, repetition.PASSAGE)) <= repetition.COVERED_PERCENT * n and longest <= repetition.LONGEST and 100 * out[2] <= repetition.SYMBOL_PERCENT * n and 100 * out[3] <= repetition.LINE_PERCENT * len(lines)
    return (*out, longest, failed, kept)


def test_random_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "\x1c\x85 b c\n\n", "a " * 30, "x\n" * 25, "# " * 40, "é" * 50 + "\U0001f600 |"]
    for _ in range(120):
        few = [rng.choice(["a", "bb", "ç,", "#d", "E\x0b"]) + str(rng.randrange(rng.choice([2, 8, 60]))) for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.4:
            k = rng.randrange(len(few))
            few += few[k : k + rng.randrange(1, 80)] * rng.randrange(1, 3)
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\t", "\r\n"]) for w in few))
    frame = spark.createDataFrame([(i % 100 or None, t, "x", 1) for i, t in enumerate(texts)], DOCS)
    got = sorted(((r["doc_id"] or 0, *r[1:6], r["longest_repeat"], r["base_failed"], r["kept"]) for r in repetition.quality(frame).collect()), key=str)
    assert got == sorted(((i % 100, *brute(t or "")) for i, t in enumerate(texts)), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_sql_and_query_agree(spark):
    from tidemark.llm.queries import QUERIES

    where = "/root/testdata/sf0.001"
    df = QUERIES["op11_quality_rules"](spark, where)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{where}/documents.parquet'")
    rel = c.sql(repetition.SQL)
    assert rel.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_texts_of_a_slab_do_not_share_passages():
    once = " ".join(f"w{i}" for i in range(70))
    m = repetition.measures([once, once, once + " " + once])
    assert m["longest_repeat"].tolist() == [0, 0, 70] and m["n_repeat_words"].tolist() == [0, 0, 140]


def test_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + " w5 w6 w7 w8" + " again" * 200_000
    m = repetition.measures([text, "b " * 9])
    assert m["longest_repeat"].tolist() == [199_999, 8] and m["n_repeat_words"].tolist() == [200_000, 9] and m["n_covered"][0] == 200_008


def test_ranks_order_the_suffixes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 60)
    owner = np.repeat([0, 1, 2], 20)
    ends = (owner + 1) * 20
    order, _ = repetition.doubling(words, ends, owner)
    assert order.tolist() == sorted(range(60), key=lambda i: (owner[i], words[i : ends[i]].tolist()))


def test_spans_and_odd_tables(spark):
    a = " ".join(f"w{i}" for i in range(8))
    rows = [(1, f"{a} x {a} {a} y"), (2, "z " * 3), (None, None), (1, f"{a} x {a} {a} y")]
    frame = spark.createDataFrame([(*r, "k", 2) for r in rows], DOCS)
    assert sorted(map(tuple, repetition.spans(frame).collect())) == [(1, 0, 8), (1, 0, 8), (1, 9, 16), (1, 9, 16)]
    assert repetition.quality(frame).count() == 4
    empty = repetition.quality(frame.limit(0))
    assert empty.count() == 0 and dict(empty.dtypes)["kept"] == "boolean" and repetition.spans(frame.limit(0)).count() == 0
