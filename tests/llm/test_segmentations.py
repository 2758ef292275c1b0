import hashlib
import itertools
import math

import numpy as np

from earlog.llm import gumbel_pieces as g
from earlog.llm.queries import op6_segmentations, tokenizer

FILE = tokenizer("piece_bpe_32k.model")
LAT = g.Lattice(FILE)


def segmentations(word):
    """All segmentations of ' word' and their normalised probabilities, by plain recursion."""
    piece = {}
    for i, r in enumerate(LAT.raw):
        if r and not (LAT.byte == i).any():
            piece.setdefault(r.decode(), i)

    def go(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in piece:
                for ids, lp in go(s[n:]):
                    yield (piece[s[:n]], *ids), lp + LAT.weight[piece[s[:n]]]
    all_ = dict(go(word))
    z = sum(math.exp(v) for v in all_.values())
    return {k: math.exp(v) / z for k, v in all_.items()}


def test_first_sample_follows_the_lattice_and_second_is_without_replacement():
    p = segmentations(" the")
    n = 4000
    rows = list(g.sample_batch(["the"] * n, np.array([g.row_seed(i, "", 1) for i in range(n)], np.uint64), 2, LAT))
    first, both = {}, {}
    for r in rows:
        a, b = tuple(r[0][4].tolist()), tuple(r[1][4].tolist())
        assert a != b and r[0][1] >= r[1][1]
        assert math.isclose(math.exp(r[0][2]), p[a], rel_tol=1e-6) and math.isclose(math.exp(r[1][2]), p[b], rel_tol=1e-6)
        first[a] = first.get(a, 0) + 1
        both[a, b] = both.get((a, b), 0) + 1
    for s, q in p.items():
        assert abs(first.get(s, 0) / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
    for (a, b) in itertools.permutations(p, 2):
        q = p[a] * p[b] / (1 - p[a])
        assert abs(both.get((a, b), 0) / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3


def test_all_segmentations_come_out_once():
    p = segmentations(" the")
    for r in g.sample_batch(["the"], np.array([3], np.uint64), 100, LAT):
        assert {tuple(x[4].tolist()) for x in r} == set(p) and len(r) == len(p)
        assert [x[1] for x in r] == sorted((x[1] for x in r), reverse=True) and all(x[3] == 1.0 for x in r)


def test_inclusion_scores_are_unbiased():
    """Horvitz-Thompson: the sum of p / inclusion over the sample estimates 1."""
    n = 3000
    rows = g.sample_batch(["the thing"] * n, np.array([g.row_seed(i, "", 2) for i in range(n)], np.uint64), 3, LAT)
    est = [sum(math.exp(x[2]) / x[3] for x in r) for r in rows]
    assert abs(np.mean(est) - 1) < 5 * np.std(est) / math.sqrt(n)


def test_round_trip_of_odd_texts(spark, odd_docs):
    out = g.sample_segmentations(odd_docs, FILE, k=2, with_text=True).collect()
    want = {}
    for r in odd_docs.collect():
        want.setdefault(r["doc_id"], set()).add(r["text"] or "")
    assert {r["doc_id"] for r in out} == want.keys()
    for r in out:
        assert r["decoded"] in want[r["doc_id"]]
    assert [len(r["ids"]) for r in out if r["doc_id"] == 1] == [0]
    assert g.sample_segmentations(odd_docs.limit(0), FILE).count() == 0


def test_seeded_by_row_key(spark, docs):
    a = g.sample_segmentations(docs.limit(50), FILE).orderBy("doc_id", "rank").collect()
    b = g.sample_segmentations(docs.limit(50).repartition(7), FILE).orderBy("doc_id", "rank").collect()
    assert a == b


def test_query(spark, sf, docs):
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = op6_segmentations(spark, sf).collect()
    assert len({(r["doc_id"], r["ids_crc32"], r["n_pieces"]) for r in got}) == len(got) >= 2 * len(want) - 5
    for r in got:
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() and r["decoded_chars"] == len(want[r["doc_id"]])
        assert 0 <= r["inclusion"] <= 1 and r["log_prob"] <= 0
