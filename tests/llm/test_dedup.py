"""Line, exact and near-duplicate removal against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import exactdedup, linededup, setjoin

DOCS = "doc_id bigint, text string, n_lines int, _cut string, kind string, rep int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "c", "k", 1) for i, t in rows], DOCS)


def lines_brute(rows):
    texts = dict(rows)
    first, cut = {}, defaultdict(set)
    for i in sorted(texts):
        ls = (texts[i] or "").split("\n")
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if w in first:
                cut[i] |= {k, k + 1, k + 2}
            else:
                first[w] = (i, k)
    return {i: t if t is None or not cut[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[i]) for i, t in texts.items()}


def test_line_dedup(spark):
    r = random.Random(2)
    rows = [(i, "\n".join(r.choice("abcde") for _ in range(r.randrange(0, 14)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "a\nb"), (203, "q\nq\nq\nq"), (204, "x\ny\nz"), (205, "x\ny\nz"), (206, "p\n\n\nr\n")]
    got = {x["doc_id"]: x["text"] for x in linededup.line_dedup(frame(spark, rows)).collect()}
    assert got == lines_brute(rows)
    assert got[203] == "q" and got[205] == ""
    assert linededup.line_dedup(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_odd_rows(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "a\nb\nc\nz"), (None, "a\nb\nc")]
    got = [(x["doc_id"], x["text"], x["kind"]) for x in linededup.line_dedup(frame(spark, rows)).collect()]
    assert Counter(got)[(2, "z", "k")] == 1 and len(got) == 4


def test_line_dedup_of_repeated_ids(spark):
    eight = "\n".join("abcdefgh")
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (2, "p\nq\nr\ns"), (3, eight + "\nf\ng\nh"), (3, "x"), (3, None), (None, "p\nq\nr\nt"), (None, "1\n2\n3"), (4, "1\n2\n3\n4"), (4, "1\n2\n3\n4")]
    got = Counter((x["doc_id"], x["text"]) for x in linededup.line_dedup(frame(spark, rows)).collect())
    assert got == Counter([(1, "a\nb\nc"), (2, "d"), (2, "p\nq\nr\ns"), (3, "e\nf\ng\nh"), (3, "x"), (3, None), (None, "t"), (None, ""), (4, "1\n2\n3\n4"), (4, "1\n2\n3\n4")])


def test_line_dedup_of_repeated_ids_against_brute_force(spark):
    r = random.Random(12)
    rows = [(r.choice([None, *range(9)]), "\n".join(r.choice("ab") + str(r.randrange(40)) for _ in range(r.randrange(0, 30)))) for _ in range(60)]
    want = {}
    for i, t in rows:  # with ids that repeat, only the order within an id is free, so each id's rows are made unlike
        want[i, t + f"\nend {len(want)}"] = None
    rows = list(want)
    lone = {i: [t for j, t in rows if j == i] for i, _ in rows}
    assert any(len(v) > 2 for v in lone.values())
    got = {(x["doc_id"], x["text"]) for x in linededup.line_dedup(frame(spark, rows)).collect()}
    place = {x: n for n, x in enumerate(x[1] for x in spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id is null as n", "doc_id", "xxhash64(1, doc_id is null, doc_id, text) as a", "text").orderBy("n", "doc_id", "a").select("n", "text").collect())}
    brute = lines_brute([(place[t], t) for _, t in rows])
    assert got == {(i, brute[place[t]]) for i, t in rows}


def test_line_dedup_of_frequent_windows_and_long_texts(spark):
    common = "same\nthree\nlines"
    rows = [(i, f"{common}\nown {i}") for i in range(400)] + [(1000, "\n".join(str(k) for k in range(200_000))), (1001, "x" * 3_000_000), (1002, "\n" * 50_000)]
    got = {x["doc_id"]: x["text"] for x in linededup.line_dedup(frame(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own {i}" for i in range(1, 400))
    assert got[1000] == rows[400][1] and got[1001] == rows[401][1] and got[1002] == ""


def test_line_dedup_keeps_clashing_columns_in_the_pipeline(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc\nd", "mine", 7), (2, "a\nb\nc", "gone", 5), (3, "a\nb\nc\ne", "cut", 7)], "doc_id bigint, text string, n_lines string, n_chars int")
    got = linededup.without_repeats(rows)
    assert got.columns == rows.columns and got.schema["n_chars"].dataType == rows.schema["n_chars"].dataType
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb\nc\nd", "mine", 7), (3, "e", "cut", 1)]
    assert linededup.without_repeats(rows.drop("n_chars")).count() == 2


def test_exact_dedup(spark):
    rows = [(i, "Same TEXT") for i in range(300)] + [(400, "same text"), (401, "SÄME"), (402, "SäME"), (403, None), (404, ""), (405, "sÄme"), (406, "one"), (406, "one"), (None, "none")]
    got = exactdedup.exact_dedup(frame(spark, rows)).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    assert len(got) == len(rows)
    want = Counter((i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exactdedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=4):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    rows, base = [], None
    for i in range(260):
        if i % 4 == 0 or base is None:
            base = [r.choice(words) for _ in range(r.randrange(3, 150))]
        text = list(base)
        for _ in range(r.randrange(0, 1 + len(text) // 25)):
            text[r.randrange(len(text))] = r.choice(words)
        if i % 3 == 0:
            text[r.randrange(len(text)) : 0] = passage
        rows.append((i, " ".join(text) if i % 5 else " ".join(text).upper()))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One  two"), (905, "one two three four"), (906, "\x1c x")]


def test_components_against_all_pairs(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(frame(spark, rows)).collect()}
    assert got == components_brute(rows)
    assert sum(v[1] != k for k, v in got.items()) > 20


def test_components_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    r = random.Random(8)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(r.randrange(0, 6)):
            text[r.randrange(len(text))] = f"u{r.randrange(50)}"
        rows.append((i, " ".join(text)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in setjoin.jaccard_components(frame(spark, rows)).collect()}
    assert got == components_brute(rows)


def test_components_of_large_groups_that_fall_apart(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    monkeypatch.setattr(setjoin, "REPRESENTATIVES", 2)
    r = random.Random(18)
    common = [f"v{k}" for k in range(60)]
    rows = []
    for i in range(160):  # one frequent passage; families that link within, chains between some of them
        own = [f"f{i % 5}x{k}" for k in range(60)]
        text = common + own
        for _ in range(r.randrange(0, 5)):
            text[r.randrange(len(text))] = f"u{r.randrange(30)}"
        rows.append((i, " ".join(text)))
    rows += [(500 + k, " ".join([f"d{j}" for j in range(k, k + 60)])) for k in range(0, 120, 3)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in setjoin.jaccard_components(frame(spark, rows)).collect()}
    assert got == components_brute(rows)


def test_bucket_count_grows_with_the_shingles():
    assert [setjoin.bucket_count(n) for n in (0, 1 << 20, 1 << 26, 1 << 33)] == [64, 64, 128, 16384]
    assert setjoin.bucket_count(1 << 44) == 1 << 21


def test_components_of_odd_tables(spark):
    assert setjoin.jaccard_components(frame(spark, [(1, "a")]).limit(0)).count() == 0
    got = sorted(tuple(r) for r in setjoin.jaccard_components(frame(spark, [(5, "a b c d e f"), (3, "A b c d e f"), (3, "a b c d e f"), (9, None)])).collect())
    assert got == [(3, 2, 3), (3, 2, 3), (5, 2, 3), (9, 0, 9)]
    long_ = " ".join(f"w{k % 9973}" for k in range(300_000))
    odd = setjoin.jaccard_components(frame(spark, [(7, long_), (8, long_ + " more"), (None, "a b c d e f"), (4, "a b c d e f"), (None, "lone words only"), (None, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in odd if r["doc_id"] is not None) == [(4, 4), (7, 7), (8, 7)]
    assert sorted((r["component_id"] is None) for r in odd if r["doc_id"] is None) == [False, True, True]


@pytest.mark.parametrize("across", [False, True])
def test_forest_connects_what_all_links_connect(across):
    rng = np.random.default_rng(1)
    for trial in range(15):
        bases = [rng.choice(5000, 40, replace=False) for _ in range(4)]
        sets = [np.unique(np.where(rng.random(40) < 0.08, rng.integers(5000, 9000, 40), bases[rng.integers(4)]).astype(np.uint64)) for _ in range(60)]
        side = (np.arange(60) % 2 if across else np.zeros(60)).astype(int)
        links = setjoin.forest(sets, side)
        want, got = list(range(60)), list(range(60))

        def root(up, x):
            while up[x] != x:
                x = up[x]
            return x

        for a in range(60):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if (not across or side[a] != side[b]) and 4 * i >= 3 * (len(sets[a]) + len(sets[b]) - i):
                    want[root(want, a)] = root(want, b)
        for a, b in links:
            assert not across or side[a] != side[b]
            got[root(got, a)] = root(got, b)
        same = lambda up: [[root(up, a) == root(up, b) for b in range(60)] for a in range(60)]
        assert same(got) == same(want), trial


def test_components_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(5, 3), (3, 5), (7, 7), (90, 80), (80, 70)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in setjoin.components(links).collect()}
    assert got == {**{k: 10 for k in range(10, 41)}, 3: 3, 5: 3, 90: 70, 80: 70, 70: 70}
