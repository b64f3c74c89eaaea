"""Phrase collocations against brute force and SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tidemark.llm import collocation

DOCS = "doc_id bigint, text string, lang string, score double, rank int"
LOWER = str.maketrans(collocation.UPPER, collocation.LOWER)


def brute(rows, least, listed=2000):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words)) for k in (1, 2, 3, 4) if i + k <= len(words))
    out = {}
    held = lambda s, b: any(b[i : i + len(s)] == s for i in range(len(b) - len(s) + 1))
    frequent = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, p), a in frequent.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if not any(o == lang and len(q) > len(p) and held(p, q) and 100 * b >= 80 * a for (o, q), b in frequent.items()):
            out.setdefault(lang, []).append((score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p, a, left, r, n[lang], s) for lang, c in out.items() for i, (s, a, p, left, r) in enumerate(sorted(c, key=lambda x: (-x[0], -x[1], x[2].encode()))[:listed])]


def some(rng, vocabulary, n):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", " ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize(("parts", "slab", "block"), [(3, 1 << 20, 1 << 20), (40, 900, 60), (400, 300, 7)])
def test_random_texts(spark, parts, slab, block):
    rng = random.Random(parts)
    words = ["the", "The", "é", "z", "Ébc", "e;", "x\x1cy", "\U0001f600", "of", "x y z"]
    rows = [(i, some(rng, words if i % 2 else ["the", "hot", "the hot"], rng.randrange(80)), rng.choice(["en", "de", None, "und"]), 1.0, 1) for i in range(60)]
    rows += [(None, None, "en", 1.0, 1), (1, "", None, 1.0, 1), (1, " \t..", "fr", 1.0, 1), *[(7, "same words here again", "de", 1.0, 1)] * 9]
    frame = spark.createDataFrame(rows, DOCS)
    got = collocation.collocations(frame, 5, parts=parts, slab=slab, block=block).collect()
    want = brute(rows, 5)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
    few = collocation.collocations(frame, 5, 3, parts=parts, slab=slab, block=block).collect()
    assert sorted(map(tuple, few)) == sorted(brute(rows, 5, 3))


def test_hot_prefixes_are_split(spark):
    rows = [(i, f"the big cat {i % 5} " * 40, "en", 1.0, 1) for i in range(30)]
    frame = spark.createDataFrame(rows, DOCS)
    found, sent = [], collocation.dealt
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([{"lang": "en", "text": r[1]} for r in rows])]
    hot = {"en": [b"the", b"the big", b"the big cat"]}
    for b in sent(batches, hot, 500):
        found += b.to_pylist()
    assert max(r["depth"] for r in found) == 4 and {r["key"] for r in found if r["depth"] == 4} > {b"the big cat 0", b"the big cat 4"}
    assert all(len(r["counts"]) // 4 < 60 for r in found)
    assert sorted(map(tuple, collocation.collocations(frame, 30, parts=50, slab=500, block=9).collect())) == sorted(brute(rows, 30))


def test_long_texts_are_cut_between_words():
    data = b" ".join(b"w%d" % i for i in range(1000)) + b"\nend of it"
    got = [(part, own) for _, part, own in collocation.cut(data, 100)]
    assert b"".join(p[:o] for p, o in got) == data and len(got) > 40
    for part, own in got[:-1]:
        assert part[own:own + 1] in (b" ", b"\n") and len(part[own:].split()) == 3
    word = b"x" * 1000
    assert [o for *_, o in collocation.cut(word, 10)] == [1000]


def test_sql_and_query_agree(spark):
    from tidemark.llm.queries import QUERIES

    where = "/root/testdata/sf0.001"
    df = QUERIES["op12_collocations"](spark, where)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{where}/documents.parquet'")
    rel = c.sql(collocation.SQL)
    assert rel.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_empty_tables(spark):
    frame = spark.createDataFrame([], DOCS)
    assert collocation.collocations(frame).collect() == []
    assert collocation.collocations(spark.createDataFrame([(1, None, None, 0.0, 1)], DOCS), 1).collect() == []


def test_scores_are_exact(spark):
    big = 9_000_000_000_000
    row = spark.sql(f"select {big}L as a, {big + 1}L as l, {big}L as r").selectExpr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as s").first()
    assert row["s"] == 2000000 * big // (2 * big + 1)
