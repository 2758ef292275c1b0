import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from earlog.llm import hmm_lm as h
from earlog.llm import quality_cnn as q
from earlog.llm.queries import op7_quality, op10_hmm


def test_chunks_cover_all_windows():
    for n in (0, 1, 5, 6, 511, 512, 513, 1019, 1020, 5000):
        data = bytes(i % 255 + 1 for i in range(n))
        c = q.chunks(data)
        windows = {bytes(w) for p in c for w in np.lib.stride_tricks.sliding_window_view(p, q.WIDTH)}
        assert {data[i:i + q.WIDTH] for i in range(n - q.WIDTH + 1)} <= windows and c.shape[1] == q.CHUNK


def test_convolution_against_plain_sums():
    rng = np.random.default_rng(1)
    net = q.Network(rng.normal(size=(256, q.DIM)), rng.normal(size=(q.WIDTH, q.DIM, q.FILTERS)), rng.normal(size=q.FILTERS), rng.normal(size=2 * q.FILTERS), .1)
    c = rng.integers(0, 256, (3, q.CHUNK)).astype(np.uint8)
    emb = net.bytes_[c]
    want = sum(emb[:, j:q.CHUNK - q.WIDTH + 1 + j] @ net.filters[j] for j in range(q.WIDTH))
    assert np.allclose(q.convolve(c, net.tables()), want, atol=1e-4)
    f = np.maximum(want.max(1) + net.bias, 0)
    assert q.probability(q.pooled(c, net, net.tables()), net) == pytest.approx(
        1 / (1 + math.exp(-(np.concatenate([f.max(0), f.mean(0)]) @ net.weights + .1))), abs=1e-5)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 1000
    rank = got["score"].rank()
    pos = got["quality"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / pos.sum() / (~pos).sum()
    assert auc > 0.95 and ((got["predicted"] == got["quality"]).mean() > 0.9)


def test_quality_odd(spark, odd_docs):
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, 1), (None, 1), (8, None), (99, 0)], "doc_id long, quality int")
    net = q.train(odd_docs, labels, epochs=2)
    out = q.score(odd_docs, net)
    assert out.columns == [c for c in odd_docs.columns if c != "score"] + ["score"]
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == odd_docs.count()
    assert q.score(odd_docs.limit(0), q.train(odd_docs.limit(0), labels.limit(0))).count() == 0


def test_forward_and_counts_against_all_paths():
    rng = np.random.default_rng(3)
    k, s = 3, 4
    m = h.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T)
    seqs = [np.array(x, np.uint16) for x in ([1], [0, 2, 3], [3, 3], [1, 0, 2, 2])]
    counts = {"start": np.zeros(k), "step": np.zeros((k, k)), "emit": np.zeros((s, k))}
    logs, want = h.forward(seqs, m), {n: np.zeros_like(v) for n, v in counts.items()}
    for x, lg in zip(seqs, logs):
        paths = {}
        for z in itertools.product(range(k), repeat=len(x)):
            paths[z] = m.start[z[0]] * np.prod([m.emit[o, a] for o, a in zip(x, z)]) * np.prod([m.step[a, b] for a, b in zip(z, z[1:])])
        total = sum(paths.values())
        assert lg == pytest.approx(math.log(total))
        for z, p in paths.items():
            want["start"][z[0]] += p / total
            for a, b in zip(z, z[1:]):
                want["step"][a, b] += p / total
            for o, a in zip(x, z):
                want["emit"][o, a] += p / total
    assert h.expected(seqs, m, counts) == pytest.approx(logs.sum())
    for n in want:
        assert np.allclose(counts[n], want[n])


def base(rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t, _ in rows}
    c = Counter(w for i, _, tr in rows if tr for w in [*words[i], None])
    n, v = sum(c.values()), len(c)
    return {i: (len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in [*ws, None])) for i, ws in words.items()}


def test_query(spark, sf, docs):
    import zlib
    want = base([(i, t, zlib.crc32(str(i).encode()) % 5 != 1) for i, t in docs.select("doc_id", "text").collect()])
    got = op10_hmm(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["base_score"] == pytest.approx(w[3], rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    """All two-token texts over the known words and one unseen word of each bucket."""
    texts = ["a b a", "b c", "c c c a", "d"]
    known, buckets = ["a", "b", "c", "d"], 3
    fresh = {}
    for k in range(200):
        fresh.setdefault(h.bucket_of(f"n{k}".encode(), buckets), f"n{k}")
    used = {h.bucket_of(w.encode(), buckets) for w in known}
    ask = [""] + known + list(fresh.values())
    rows = [(k, t, True) for k, t in enumerate(texts)] + [(100 + k, t, False) for k, t in enumerate(ask)]
    for share in (14, 1):                                    # all words have symbols of their own; most share a bucket
        got = h.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), states=2, passes=2, frequent=share, buckets=buckets, looked_up=share + 1)
        p = {r["doc_id"]: 10 ** r["score"] for r in got.collect()}
        assert len(fresh) == buckets and used and all(0 < x < 1 for x in p.values())
        assert sum(x for k, x in p.items() if k >= 100) < 1 + 1e-9


def test_odd(spark, odd_docs):
    got = h.language_model_scores(odd_docs.withColumn("train", h.F.col("doc_id") != 3), states=3, passes=1).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    none = h.language_model_scores(odd_docs.withColumn("train", h.F.lit(None).cast("boolean"))).collect()
    assert len(none) == len(got) and {r["train_tokens"] for r in none} == {0}
    assert h.language_model_scores(odd_docs.limit(0)).count() == 0
