"""Language ID, nearest neighbours, licences, main text, packing, pipeline."""

import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import annforest, langid, license, mincut, packing

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, score double, share int, nth int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 1, 1) for r in rows], DOCS)


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs, 60)).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id")))
    r = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.min("score"), F.max("score")).first()
    assert r[1] / r[0] > 0.95 and 0 <= r[2] <= r[3] <= 1
    assert zlib.crc32(b"17") % 5 == 0 or not docs.filter("doc_id = 17").select(langid.held_out(F.col("doc_id"))).first()[0]


def test_weights_come_from_rows_left_out():
    rng = np.random.default_rng(5)
    words = [["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(60)] for _ in range(3)]
    texts = [" ".join(rng.choice(words[k] if rng.random() < 0.7 else words[(k + 1) % 3], 12)) for k in range(3) for _ in range(25)]
    y = np.repeat(np.arange(3), 25)
    x, _ = langid.features(texts)
    model = langid.Model(["a", "b", "c"], x, y, 0.3)
    by_features = object.__new__(langid.Model)
    target = model.code[y].astype(np.float64)
    root = np.ones((len(y), 1))
    left_out = by_features._of_features(x, target, root, 0.3)
    again = object.__new__(langid.Model)
    assert np.allclose(left_out, again._of_rows(x, target, root, 0.3), atol=1e-3) and np.allclose(again.weights, by_features.weights, atol=1e-4)
    for i in range(0, len(y), 7):  # the closed form is a fit without the row
        keep = np.arange(len(y)) != i
        one = object.__new__(langid.Model)
        one._of_rows(x[keep], target[keep], root[keep], 0.3)
        assert np.allclose(x[i] @ one.weights + one.bias, left_out[i], atol=1e-3)
    assert model.trust.std() > 0 and np.allclose(model.trust.sum(axis=1), 1)
    # fitted on all rows every bit is right about every row, so such weights would be equal
    assert ((x @ model.weights + model.bias) * target > 0).mean() > (left_out * target > 0).mean()


def test_held_out_without_an_id(spark):
    rows = spark.createDataFrame([(None,), (17,)], "doc_id bigint")
    assert [r[0] for r in rows.select(langid.held_out(F.col("doc_id"))).collect()] == [True, zlib.crc32(b"17") % 5 == 0]


def test_language_sample_of_each_language(spark, monkeypatch):
    used = []
    monkeypatch.setattr(langid, "Model", lambda names, x, y: used.append((names, np.bincount(y).tolist())))
    langid.fit(frame(spark, [(i, f"the cat {i}", "en") if i % 2 else (i, f"le chat {i}", "fr") for i in range(1600)]))
    assert used == [(["en", "fr"], [500, 500])]


def test_language_of_odd_rows(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    odd = [(100, None, None), (101, "", "en"), (102, "123 !?", "en"), (103, "the dog", None), (103, "the dog", None), (None, "le chien et", None)]
    docs = frame(spark, train + odd)
    rows = langid.identify(docs, langid.fit(docs)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 46
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (100, 101, 102))
    assert got[103]["lang_pred"] == "en" and got[None]["lang_pred"] == "fr"
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
    blank = langid.identify(docs, langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}


def test_codebooks_tell_languages_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = langid.codebook(n)
        assert min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2)) >= (1 if n < 3 else 2)


@pytest.mark.parametrize("where", [DATA, "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, where):
    rows = spark.read.parquet(f"{where}/embeddings.parquet")
    got = annforest.nearest(rows).toPandas()
    ids, x = zip(*[(r["vec_id"], np.array(r["embedding"], np.float64)) for r in rows.collect()], strict=True)
    ids, x, hits, total = np.array(ids), np.stack(x), 0, 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -9
        best = ids[np.lexsort((ids, -score))[:20]]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine.score) <= 0).all()
        assert np.allclose(mine.score, [x[ids == v][0] @ x[ids == q][0] for v in mine.vec_id], atol=1e-12)
        hits, total = hits + len(set(best) & set(mine.vec_id)), total + 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("copies", [4, 8, 13, 19])
def test_recall_of_queries_with_copies(copies):
    rng = np.random.default_rng(copies)
    x = rng.standard_normal((2000, 64))
    x[20 : 20 * copies] = np.tile(x[:20], (copies - 1, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits = np.arange(2000), 0
    for q, near, _ in annforest.search(x[:20], ids[:20], x, ids):
        score = x @ x[q]
        score[q] = -9
        # copies tie to rounding, so they are ranked by id
        best = np.lexsort((ids, -np.round(score, 9)))[:20]
        hits += len(set(best) & set(near.tolist()))
        assert copies - 1 == sum(v % 20 == q and v < 20 * copies for v in near)
    assert hits / 400 >= 0.9


def test_scores_of_close_and_of_huge_vectors():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(32) + 1e-9 * rng.standard_normal((400, 32))  # nearer to one another than single precision tells
    for scale in (1.0, 1e150):
        ids = np.arange(400)
        (_, near, score), *_ = annforest.search(x[:1] * scale, ids[:1], x * scale, ids, 20, 1.0)
        want = np.array([float(np.dot(v * scale, x[0] * scale)) for v in x])
        want[0] = -np.inf
        assert near.tolist() == np.lexsort((ids, -want))[:20].tolist() and score.tolist() == want[near].tolist()


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [-1.0, 0.0]), (20, [0.0, 2.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [])]
    got = annforest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 0.5), (0, 2, 0.5), (0, 20, 0.0), (0, 7, -1.0), (20, 1, 1.0), (20, 2, 1.0), (20, 0, 0.0), (20, 7, 0.0)]
    assert annforest.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_license_forms(spark):
    mit = license.KNOWN[0][1]
    rows = [(1, mit, None), (2, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("LICENSE", "LICENCE", 1), None), (3, mit + " more", None), (4, "intro\nReleased under the  MIT licence!\nLicensed under CC BY-NC 4.0.", None), (5, None, None), (5, None, None), (6, "", None)]
    rows = [(a, b.replace(" ", "\t ") if a == 1 else b, c) for a, b, c in rows]
    got = {r["doc_id"]: r for r in license.scan(frame(spark, rows)).collect()}
    assert [got[k]["license_id"] for k in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert got[4]["notices"] == "CC-BY-NC-4.0,MIT"
    assert license.scan(frame(spark, rows)).count() == 7
    assert license.scan(frame(spark, rows).limit(0)).count() == 0


def test_further_license_forms(spark):
    with open("/usr/share/common-licenses/Apache-2.0") as f:
        apache = f.read()
    zlib_ = license.KNOWN[5][1].split("\n\n", 1)[1]
    rows = [(1, apache), (2, zlib_), (3, "a\nReleased under the Apache License, Version 2.0.\nb"), (4, "a\nReleased under CC BY 4.0\n" + " ".join(zlib_.split()))]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in license.scan(frame(spark, [(i, t, None) for i, t in rows])).collect()}
    assert got[1][0] == "Apache-2.0" and got[2][0] == "Zlib" and got[3] == (None, "Apache-2.0") and got[4] == (None, "CC-BY-4.0,Zlib")
    own = license.known(spark, (("Own", "Use this freely, at home."),))
    assert [r["notices"] for r in license.scan(frame(spark, [(1, "a\nUse this freely at home\nb", None)]), own).collect()] == ["Own"]
    given = spark.createDataFrame([(" ".join(b.split()),) for _, b in license.KNOWN + license.MORE], "t string")
    assert given.filter(~F.col("t").rlike(license.LINE)).count() == 0


def test_equal_neighbours_are_respelt(spark):
    got = spark.createDataFrame([(" licence licence, Licence favour-favour https://x",)], "t string").select(license.canonical(F.col("t"))).first()[0]
    assert got == "license license license favor favor http x"


def test_long_and_repeating_lists(spark, monkeypatch):
    rows = [(1, "Use this freely, at home.", None), (2, "a\nuse THIS freely at home\n\nUse that", None), (2, "a\nuse THIS freely at home\n\nUse that", None), (None, "", None), (4, None, None), (5, "y " * 300_000 + "\nuse that", None)]
    own = license.known(spark, (("B", "Use this freely at home"), ("C", "use that")))
    own = own.union(own.selectExpr("digest", "concat('A', license_id)"))
    short = sorted(map(tuple, license.scan(frame(spark, rows), own).collect()), key=str)
    assert [r[2:] for r in short if r[0] == 2] == [(None, "AB,AC")] * 2 and [r[2:] for r in short if r[0] == 1] == [("AB", "AB")]
    monkeypatch.setattr(license, "LISTED", 1)
    assert sorted(map(tuple, license.scan(frame(spark, rows), own).collect()), key=str) == short
    assert license.scan(frame(spark, rows), own.limit(0)).filter("license_id is not null or notices <> ''").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- note --><div class="cookie-notice">We use cookies, as all sites do nowadays.</div>
<div id="sidebar"><p>Read our other long and interesting stories about all kinds of things.</p></div>
<main><article><h1>The &amp; title</h1><p>First   long paragraph of the story,<br>with a <a href=y>link</a> &copy; and more words.<p>Second <b>paragraph</b> is long enough to be kept as well.</p><ul><li>A short item</li></ul></article>
<section class="comments"><article class="comment"><p>I liked this story very much and wrote a long comment on it.</p></article></section>
<form><p>Sign up for our newsletter with your address, dear reader.</p></form></main><aside><p>Advert text that is quite long, so that length alone does not tell.</p></aside><footer><p>&copy; Site, all rights reserved, and so on.</p></footer>"""


@pytest.mark.parametrize("start", ["- " * 1500, "." * 3000, "x" * 3000 + " "])
def test_words_after_a_long_start(start):
    prose = "words of a long story that goes on and on. " * 40
    gain = lambda text: mincut.fit().gain(mincut.blocks_of(f"<div>{text}</div>"))
    assert gain(start + prose) == gain(prose) and gain(prose)[0] > 0


def test_cut_labels_better_than_the_classifier_alone():
    model, held = mincut.fit(), mincut.labelled(250, 1234)
    alone, cut = mincut.accuracy(mincut.Model(model.weights, 0.0), held), mincut.accuracy(model, held)
    assert model.scale > 0 and cut > alone + 0.01 and cut > 0.94
    told = [(b, want) for b, want in held if any(x.around[0] for x in b)]
    assert len(told) > 80 and mincut.accuracy(model, told) > 0.96


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a t="' * 170_000, "<p a=\"b'>" * 100_000, "<script>" + "</script " * 100_000, "<div>" * 80_000 + "</p>" * 80_000, "<i><div>" + "<b>" * 80_000 + "</i>" * 80_000, "<!--" * 250_000, "<" * 200_000])
def test_broken_pages_in_linear_time(page):
    began = time.process_time()
    mincut.main_text(page)
    assert time.process_time() - began < 4


def test_long_page_is_read_whole():
    body = [f"Paragraph number {k} of a story that is long enough to be kept." for k in range(30_000)]
    assert mincut.main_text("<article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>") == "\n".join(body)


def test_main_text():
    assert mincut.main_text(PAGE).split("\n") == ["The & title", "First long paragraph of the story, with a link © and more words.", "Second paragraph is long enough to be kept as well.", "A short item"]
    for broken in ("", "<", "<p", "a < b", "<!--", "<script>x", "</p></div>", "<div class='ad'>x</div>", "<![CDATA[x"):
        mincut.main_text(broken)


def test_minimum_cut_against_all_labellings():
    r = random.Random(6)
    for _ in range(60):
        n = r.randrange(1, 9)
        gain = [round(r.uniform(-2, 2), 3) for _ in range(n)]
        edges = [(a, b, round(r.uniform(0, 1.5), 3)) for a in range(n) for b in range(a) if r.random() < 0.4]

        def cost(labels):
            return sum(max(0, g) for g, c in zip(gain, labels, strict=True) if not c) + sum(max(0, -g) for g, c in zip(gain, labels, strict=True) if c) + sum(w for a, b, w in edges if labels[a] != labels[b])

        assert cost(mincut.min_cut(gain, edges)) == pytest.approx(min(map(cost, itertools.product((True, False), repeat=n))))


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (None, None, PAGE, "x")], "page_id bigint, url string, html string, text string")
    got = mincut.extract(rows).orderBy(F.asc_nulls_last("page_id")).collect()
    assert [r["n_chars"] for r in got] == [len(mincut.main_text(PAGE)), 0, 0, 0, len(mincut.main_text(PAGE))]
    assert mincut.extract(rows.limit(0)).count() == 0


def holds(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= capacity
    return len(by)


def test_pack_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = packing.pack_documents(docs).collect()
    total = sum(r["length"] for r in got)
    assert holds(got, 1024) <= 1.01 * -(-total // 1024) + 1
    enc = packing.encoder("byte_bpe_50k.json")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(texts)
    for doc, rows in pieces.items():
        ids = np.append(enc.encode_to_numpy(texts[doc], allowed_special="all"), np.uint32(2)).astype("<u4")
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and sum(r["length"] for r in rows) == len(ids)
        assert len(rows) == 1 or all(r["length"] == 1024 for r in rows[1:])
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_pack_odd_rows(spark):
    rows = [(1, None, None), (2, "", None), (3, "a " * 1023, None), (4, "a " * 3000, None), (4, "a " * 3000, None), (None, "x", None)]
    got = packing.pack_documents(frame(spark, rows)).collect()
    holds(got, 1024)
    assert sorted(r["length"] for r in got if r["doc_id"] in (1, 2)) == [1, 1]
    assert packing.pack_documents(frame(spark, rows).limit(0)).count() == 0


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000 + "x", "a<|endoftext|>" + "\t" * 1_500_000 + "<|endoftext|>", "it's <|endoftext|> \u00e9\u4e2d  x"])
def test_ids_of_long_white_space(text):
    assert packing.ids_of("byte_bpe_50k.json", text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_pack_very_long_texts(spark):
    docs = frame(spark, [(1, " " * 2_000_000, None), (2, "word " * 200_000, None)])
    got = packing.pack_documents(docs).collect()
    holds(got, 1024)
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == len(packing.ids_of("byte_bpe_50k.json", " " * 2_000_000)) + 1


def fewest(items, capacity):
    """The least number of bins, over all ways."""
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[k] <= capacity:
                place(k + 1, [*bins[:j], bins[j] + items[k], *bins[j + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


def test_program_covers_and_is_bounded():
    rng = np.random.default_rng(9)
    for trial in range(3):
        lengths = np.sort(rng.choice(np.arange(90 + 100 * trial, 700), 40, replace=False))
        need = rng.integers(1, 300, 40)
        times, bound, scales = packing.covering(lengths, need, 1024)
        cover = np.zeros(40)
        for key, n in times.items():
            assert sum(int(lengths[i]) * k for i, k in key) <= 1024
            for i, k in key:
                cover[i] += k * n
        value, used = sum(times.values()), sum(n for _, n in packing.plan(dict(zip(lengths.tolist(), need.tolist(), strict=True))))
        assert (cover >= need * (1 - 1e-9)).all() and 1 <= scales[0] <= scales[1]
        assert lengths @ need / 1024 <= bound + 1e-6 and bound <= value and bound <= used + 1e-6 and used <= value + len(times)


def test_plans_of_tiny_inputs_against_all_ways():
    r = random.Random(21)
    for _ in range(25):
        items = sorted((r.randrange(1, 12) for _ in range(r.randrange(1, 9))), reverse=True)
        used = sum(n for _, n in packing.plan({k: items.count(k) for k in items}, 12))
        assert fewest(items, 12) <= used <= fewest(items, 12) + 1


def test_plans_hold_the_histogram():
    rng = np.random.default_rng(4)
    for trial in range(4):
        h = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 1025), 60 * (trial + 1), replace=False), rng.integers(1, 400, 60 * (trial + 1)), strict=True)}
        got = {}
        for content, n in packing.plan(h):
            assert sum(content) <= 1024
            for k in content:
                got[k] = got.get(k, 0) + n
        assert got == h
    assert packing.plan({}) == []


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline as cp
    from test_dedup import components_brute, lines_brute

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(5001, None, "en", "s", 0), (5002, "123", "en", "s", 3), (5003, "", None, None, None)], docs.schema)
    docs = docs.union(odd)
    kept = cp.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert {i for i, _ in rows} == {r["doc_id"] for r in docs.collect()} - {5001, 5002, 5003}
    lean = cp.dedup_lines(spark, kept, "")
    want = {i: t for i, t in lines_brute(rows).items() if t or dict(rows)[i] == ""}
    assert lean.columns == docs.columns and {r["doc_id"]: r["text"] for r in lean.collect()} == want
    one = cp.keep_one_of_each_group(spark, lean, "")
    stays = {i for i, (_, c) in components_brute(list(want.items())).items() if i == c}
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == stays
    packed = cp.pack(spark, one, "").collect()
    holds(packed, 1024)
    assert {r["doc_id"] for r in packed} == stays


def test_pipeline_keeps_documents_without_an_id(spark):
    import corpus_pipeline as cp

    r = random.Random(3)
    a, b, c, d = ([f"{k}{r.randrange(10**6)}" for _ in range(80)] for k in "abcd")
    near = lambda x, k: " ".join([*x[:-1], f"other{k}"])
    rows = [(5, " ".join(a)), (None, near(a, 1)), (None, " ".join(b)), (None, near(b, 2)), (None, " ".join(c)), (None, " ".join(c)), (9, " ".join(d)), (None, ""), (None, None)]
    docs = frame(spark, [(i, t, "en") for i, t in rows])
    got = cp.keep_one_of_each_group(spark, docs, "")
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and got.columns == docs.columns
    kept = [(x["doc_id"], x["text"]) for x in got.collect()]
    assert len(kept) == 6 and {(5, " ".join(a)), (None, " ".join(c)), (9, " ".join(d)), (None, ""), (None, None)} < set(kept)
    assert len({(None, " ".join(b)), (None, near(b, 2))} & set(kept)) == 1
    assert sum(x["doc_id"] is None for x in cp.pack(spark, got, "").collect()) == 4
    alone = cp.keep_one_of_each_group(spark, docs.filter("doc_id is null"), "")
    assert alone.count() == 5


def test_pipeline_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline as cp

    r = random.Random(5)
    a, b = ([f"{k}{r.randrange(10**6)}" for _ in range(80)] for k in "ab")
    near = " ".join([*a[:-1], "other"])
    a, b = " ".join(a), " ".join(b)
    stage = lambda rows: sorted((x["doc_id"], x["text"]) for x in cp.keep_one_of_each_group(spark, frame(spark, [(*x, "en") for x in rows]), "").collect())
    assert stage([(0, a), (1, near), (1, b)]) == [(0, a), (1, b)]
    assert stage([(0, a), (1, a), (1, b)]) == [(0, a), (1, b)]
    assert stage([(3, a), (1, a), (1, a)]) == [(1, a)]
    assert stage([(2**62 + 5, a), (2**62 + 5, b), (7, near)]) == [(7, near), (2**62 + 5, b)]


def test_pipeline_groups_with_random_repeated_ids(spark):
    import corpus_pipeline as cp
    from test_dedup import components_brute

    r = random.Random(8)
    texts = [" ".join(f"{k}{r.randrange(10**6)}" for _ in range(60)) for k in range(9)]
    rows = []
    for _ in range(60):
        words = r.choice(texts).split()
        words[r.randrange(60)] = r.choice([words[0], "x"])
        rows.append((r.choice([None, *range(12)]), r.choice(["", None]) if r.random() < 0.1 else " ".join(words)))
    got = [(x["doc_id"], x["text"]) for x in cp.keep_one_of_each_group(spark, frame(spark, [(*x, "en") for x in rows]), "").collect()]
    group = {i: c for i, (_, c) in components_brute([(i, t) for i, (_, t) in enumerate(rows)]).items()}
    want = {}
    for i, (doc_id, _) in enumerate(rows):
        want[group[i]] = min(want.get(group[i], (True, 0)), (doc_id is None, doc_id or 0))
    of_text = {t: group[i] for i, (_, t) in enumerate(rows) if t}
    assert len(got) == len(want) and set(got) <= set(rows)
    assert {of_text[t]: (i is None, i or 0) for i, t in got if t} == {g: v for g, v in want.items() if g in set(of_text.values())}


def test_pipeline_stages_of_odd_tables(spark):
    import corpus_pipeline as cp

    line = "one line\nanother line\na third line"
    rows = [(1, line, "en", "mine"), (1, line, "en", "mine"), (2, line + "\nits own " + "text " * 9, "en", "mine"), (3, None, "en", None), (4, "", None, None), (5, "the cat and the dog sat on the mat " * 3, "en", "x"), (6, "le chat et le chien " * 5, "fr", "y"), (7, "the cat " * 200_000, "en", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_removed string")
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and got.schema == docs.schema, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
        docs = spark.createDataFrame(got.collect(), docs.schema)
    kept = sorted(map(tuple, docs.collect()))
    assert [r[0] for r in kept] == [1, 2, 5, 6, 7] and kept[1][1] == "its own " + "text " * 9 and kept[1][3] == "mine"  # of the row that repeats one stays
    packed = cp.pack(spark, docs, "").collect()
    holds(packed, 1024)
    assert {r["doc_id"] for r in packed} == {1, 2, 5, 6, 7} and cp.pack(spark, docs.limit(0), "").count() == 0


def test_pipeline_deletes_what_nothing_reads_any_more(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp
    from tidemark.llm import common

    monkeypatch.setattr(common, "scratch_dir", lambda _: f"file://{tmp_path}")
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
    left = [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()]
    assert "near_duplicates" in left and not {"language_id", "line_dedup", "near", "met", "able", "members"} & set(left)
