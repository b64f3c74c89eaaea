"""Scan, transducers and codec against the libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpecodec, packing, tokencount
from tidemark.llm.textscan import Scan, groups, monoid
from tidemark.llm.transducer import Transducer
from tidemark.llm.vocab import load

ALPHABET = "ab 'stmdrevl  \n\t é1٣$!'　\x85\U0001f600\0"
DOCS = "doc_id bigint, text string, kind string, score double, n_tokens int"


def fuzz(n=3000, alphabet=ALPHABET, seed=5, most=40):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(most))) for _ in range(n)]


ODD = ["a" * 3000, "ab" * 700, "", " ", "\n\n\n", "<|endoftext|>x <|endoftext|>", "it's 'tis we'll they've''s", "ß" * 50 + "١٢"]


def test_scan_matches_the_pattern():
    texts, pattern = fuzz() + ODD, regex.compile(public_tokenizers.PATTERN)
    scan = Scan(texts)
    raw, found = scan.data.tobytes(), [[] for _ in texts]
    for a, b, d in zip(scan.start.tolist(), scan.end.tolist(), scan.doc.tolist(), strict=True):
        found[d].append(raw[a:b].decode())
    assert found == [pattern.findall(t) for t in texts]
    assert len(monoid()[1]) < 64


def test_groups_cover_all_texts():
    texts = ["x" * n for n in (5, 0, 100, 3, 3, 3)]
    assert [k for a, b in groups(texts, 8) for k in range(a, b)] == list(range(6))
    assert list(groups([])) == []


def library():
    return Tokenizer.from_file(public_tokenizers.path(tokencount.VOCABULARY))


def test_counts_match_the_library():
    texts = fuzz() + ODD + fuzz(500, "thinger aion", 9)
    assert tokencount.count_texts(texts).tolist() == [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]


def test_a_full_table_starts_anew(monkeypatch):
    from tidemark.llm import transducer

    monkeypatch.setattr(transducer, "MOST", 4000)
    machine = Transducer(load(tokencount.VOCABULARY))
    texts = fuzz(800, "abcdefghijklmnopqrstuvwxyz ", 3, 60) + ["".join(fuzz(300, "abcdefghijklmnopqrstuvwxyz", 4, 40))]
    scan = Scan(texts)
    got = [0] * len(texts)
    for d, n in zip(scan.doc.tolist(), machine.count(scan).tolist(), strict=True):
        got[d] += n
    assert got == [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]


def test_chunk_maps_compose_to_the_count_of_the_whole():
    machine, r = Transducer(load(tokencount.VOCABULARY)), random.Random(7)
    texts = ["".join(r.choice("etaoinshrdlu") for _ in range(9000)), "ab" * 3000, "x" * 5000, "thing" * 1500, "".join(r.choice(["the", "ing", "q", "zz"]) for _ in range(3000))]
    for t in texts:
        scan = Scan([t])
        assert len(scan.start) == 1
        a, b = int(scan.start[0]), int(scan.end[0])
        whole = int(machine.run(scan.data, scan.start, scan.end)[0][0])
        assert whole == len(library().encode(t, add_special_tokens=False).ids)
        for chunk in (37, 512, 100_000):
            assert machine.long(scan.data, a, b, chunk) == whole
        # two halves read by themselves, then composed
        start, cut = machine.states[0], (a + b) // 3
        left = ({start: (machine.states[int((got := machine.run(scan.data, np.array([a]), np.array([cut])))[1][0])], int(got[0][0]))}, a, cut)
        assert machine.compose(scan.data, left, ({}, cut, b))[0][start][1] == whole


def test_counts_and_codec_of_very_long_texts():
    r = random.Random(8)
    texts = ["".join(r.choice("etaoinshrdlu") for _ in range(300_000)), " " * 500_000 + "x", "word " * 100_000, "!" * 200_000]
    want = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    assert tokencount.count_texts(texts).tolist() == want
    c = bpecodec.codec(bpecodec.VOCABULARY)
    assert [c.decode(x).decode() for x in c.encode(texts)] == texts


def test_codec_matches_the_library_and_round_trips():
    name = bpecodec.VOCABULARY
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = fuzz() + ODD + fuzz(500, "thinger aion", 9)
    c = bpecodec.codec(name)
    ids = c.encode(texts)
    assert [x.tolist() for x in ids] == [lib.encode_ordinary(t) for t in texts]
    assert [c.decode(x).decode() for x in ids] == texts


def test_packing_encoder_gives_the_library_ids():
    texts = fuzz(1000) + ODD
    enc = packing.encoder("byte_bpe_50k.json")
    assert [enc.encode_to_numpy(t, allowed_special="all").tolist() for t in texts] == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, "x", 1.0, 3) for n, t in enumerate(ODD)] + [(50, None, None, None, None), (0, ODD[0], "x", 1.0, 3), (None, "a b", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_token_counts_rows(spark, docs):
    got = sorted(map(tuple, tokencount.token_counts(docs).collect()), key=str)
    lib = library()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(lib.encode(r["text"] or "", add_special_tokens=False).ids), n > 512) for r in docs.collect()), key=str)
    assert got == want
    assert tokencount.token_counts(docs.limit(0)).count() == 0


def test_codec_rows(spark, docs):
    for r, d in zip(bpecodec.digests(docs.coalesce(1)).collect(), docs.coalesce(1).collect(), strict=True):
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    assert bpecodec.digests(docs.limit(0)).count() == 0
    back = bpecodec.decode_documents(bpecodec.encode_documents(docs.filter("doc_id = 6"))).collect()
    assert bytes(back[0]["data"]).decode() == ODD[6]
