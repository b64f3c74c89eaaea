"""Conversation prefix trie against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from tidemark.llm import convtrie

ROWS = "conv_id bigint, turn bigint, role string, text string, depth int, words string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    first = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in first.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20 if c < 0 else c % 20
        whole = tuple(first.get(c - base, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()]


def both(spark, rows):
    got = convtrie.trie(spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)).collect()
    return sorted(map(tuple, got), key=str), sorted(brute(rows), key=str)


def made(rng, ids, kinds, longest):
    rows = []
    for c in ids:
        n = rng.randrange(longest)
        rows += [(c, rng.choice([None, k, k, k, k // 2]), rng.choice(["user", "bot", None, ""]), rng.choice(kinds)) for k in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 2), (3, 3)])
def test_random_conversations(spark, monkeypatch, seed, block):
    monkeypatch.setattr(convtrie, "BLOCK", block)
    monkeypatch.setattr(convtrie, "RANGE", 3)
    rng = random.Random(seed)
    ids = rng.sample(range(-30, 90), 70) + [10**15 + k for k in range(5)]
    kinds = ["hi", "hi you", None, "", "a\x1cb c", "one two three", "\n", "é"]
    got, want = both(spark, made(rng, ids, kinds if seed == 1 else kinds[:2], 9))
    assert got == want


def test_long_and_copied_conversations(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "BLOCK", 16)
    line = [(k, "user", f"t{k % 7} and more") for k in range(70)]
    rows = [(c, *t) for c in (20, 25, 44, 63, 101) for t in line[: 70 - c % 9]] + [(c, 0, "user", "hello there") for c in range(200, 260)]
    rows += [(300 + k, i, "user", f"t{i % 7} and more") for k in range(30) for i in range(k)]  # each one a turn longer
    got, want = both(spark, rows)
    assert got == want and max(r[1] for r in got) >= 69


def test_names_of_nodes_need_the_order(spark):
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (20, 0, "u", "b"), (20, 1, "u", "a"), (40, 0, "u", "a"), (40, 1, "u", "a")]
    got, want = both(spark, rows)
    assert got == want and len(got) == 1 + 2 + 3


def test_nodes_of_a_family_in_small_pieces():
    rows = [{"base": 0, "conv_id": c, "pos": p, "words": 2, "length": 5, "_block": p // 2, "_xa": 10 + p, "_xb": 5, "_ca": sum(10 + q for q in range(p // 2 * 2)), "_cb": 5 * (p // 2 * 2)} for c in (1, 2) for p in range(5)]
    rows.sort(key=lambda r: (r["_block"], r["conv_id"], r["pos"]))
    whole = list(convtrie._tries(iter([pa.RecordBatch.from_pylist(rows)])))
    got = sorted(((r["depth"], r["a"], r["pa"], r["conv_id"], r["n"], r["ends"]) for b in whole for r in b.to_pylist()))
    assert got == [(p + 1, sum(10 + q for q in range(p + 1)), sum(10 + q for q in range(p)), 1, 2, [1, 2] if p == 4 else []) for p in range(5)]


def test_odd_tables(spark):
    frame = spark.createDataFrame([], ROWS)
    assert convtrie.trie(frame).collect() == []
    assert convtrie.trie(spark.createDataFrame([(None, 1, "u", "t", 1, "x")], ROWS)).collect() == []
    alone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][0]
    got, want = both(spark, [(alone, 0, "u", "t"), (alone, 0, "u", "t")])  # all its turns go, and there is no base
    assert got == want == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_sql_and_query_agree(spark):
    from tidemark.llm.queries import QUERIES

    where = "/root/testdata/sf0.01"
    df = QUERIES["op13_conversation_trie"](spark, where)
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{where}/conversations.parquet'")
    rel = c.sql(convtrie.SQL)
    assert rel.columns == df.columns
    want = sorted(rel.fetchall(), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want
    rows = c.sql("select conv_id, turn, role, text from conversations").fetchall()
    assert sorted(brute(rows), key=str) == want
