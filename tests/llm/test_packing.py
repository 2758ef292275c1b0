import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from earlog.llm import packing as p
from earlog.llm.queries import op4_packing, tokenizer

FILE = tokenizer("word_bpe_49k.json")
TOK = Tokenizer.from_file(FILE)


def ids(t):
    return TOK.encode(t or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abZÉéßİı'.,$-09ª  \n\t\x0b\x1c\x85 ́ffi<|endoftext|>日", max_size=40), max_size=4))
def test_words_equal_whole_texts(texts):
    enc = p.WordEncoder(FILE)
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == [ids(t)[:-1] for t in texts]


@given(st.lists(st.integers(1, 50), max_size=80))
def test_first_fit(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    bins, offsets = p.first_fit_decreasing(sizes, 50)
    free = []
    for s, b, o in zip(sizes, bins, offsets):                # plain first fit
        k = next((k for k, f in enumerate(free) if f >= s), len(free))
        if k == len(free):
            free.append(50)
        assert (b, o) == (k, 50 - free[k])
        free[k] -= s


def check(rows, docs):
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(ids(t))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == want.keys()
    for i, rs in by_doc.items():
        pieces = sorted((x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in rs)
        assert pieces == sorted((s, len(a[s:s + 2048]), zlib.crc32(np.array(a[s:s + 2048], "<u4").tobytes()), len(a))
                                for a in want[i] for s in range(0, len(a), 2048))
    for rs in by_seq.values():
        at = 0
        for x in sorted(rs, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 2048
    used, total = sum(r["length"] for r in rows), 2048 * len(by_seq)
    return used / total if total else 1


def test_query(spark, sf, docs):
    assert check(op4_packing(spark, sf).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()]) > 0.97


def test_odd(spark, odd_docs):
    rows = p.pack(p.token_pieces(odd_docs, FILE), group_pieces=7)
    check(rows.collect(), [tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert rows.where("doc_id = 8").first()["ids"] == ids("x")
    assert p.pack(p.token_pieces(odd_docs.limit(0), FILE)).count() == 0


def test_clashing_names(spark):
    pieces = spark.createDataFrame([(i, 0, 5 + i, "h", "g", "b", -1) for i in range(20)],
                                   "doc_id long, start long, length long, _h string, _group string, `a``b` string, offset long")
    out = p.pack(pieces, capacity=64, group_pieces=8)
    assert set(out.columns) == set(pieces.columns) | {"sequence_id"}
    assert {(r["_h"], r["_group"], r["a`b"]) for r in out.collect()} == {("h", "g", "b")} and out.where("offset < 0").count() == 0
