"""Nearest neighbours by tiles: both directions of a cell at once, few pairs compared number by number, few copies of a row."""
import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from earlog.operators import knn, similarity


def vectors(n, rng, copies=0, first=0):
    """Rows as the grid ships them: some without numbers, some the copy of another, some ids twice."""
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[::37] = np.nan
    x[n - copies:] = x[1]
    ids = np.arange(first, first + n)
    ids[5:8] = ids[4]
    return pd.DataFrame({"id": ids, "x": list(x)})


@pytest.mark.parametrize("copies", [0, 150])
@pytest.mark.parametrize("held", [1 << 21, 500])
def test_both_directions_of_a_cosine_cell(copies, held, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(knn, "QUICK", 4000)
    monkeypatch.setattr(knn, "PAIRS", 50)
    monkeypatch.setattr(knn, "HELD", held)
    measure = similarity.cosine_measure()
    plain = dataclasses.replace(measure, sides=None)
    a, b = vectors(400, rng, copies), vectors(300, rng, copies, first=1000)
    ahead, back, own = (knn.block(*rows, plain, 4) for rows in ((a, b), (b, a), (a, a)))
    whole = pd.concat([ahead, back])
    for got, want in ((knn.block(a, b, measure, 4, both=True), whole), (knn.block(a, a, measure, 4, both=True), own)):
        got, want = (v.sort_values(["seed", "low", "other"]).reset_index(drop=True) for v in (got, want))
        assert got["seed"].tolist() == want["seed"].tolist() and np.allclose(got["low"], want["low"], atol=1e-12)
        if not copies:                                       # a product of matrices gives copies distances that differ by rounding
            assert got["other"].tolist() == want["other"].tolist()


def test_few_cosines_are_compared_number_by_number():
    """The quick look in single precision leaves little; every pair of a cell is looked at once for both rows."""
    rows = pd.DataFrame({"id": np.arange(2000), "x": list(np.random.default_rng(4).normal(size=(2000, 16)))})
    measure, seen, looked = similarity.cosine_measure(), [], []

    def pairs(a, r, b, c):
        seen.append(len(r))
        return measure.pairs(a, r, b, c)

    def screen(a, b):
        out = measure.screen(a, b)
        looked.append(out[0].size)
        return out
    knn.block(rows, rows, dataclasses.replace(measure, pairs=pairs, screen=screen), 5, both=True)
    assert 5 * 2000 <= sum(seen) < 2 * 5 * 2000 and sum(looked) < 0.7 * 2000 * 2000


def test_bounds_narrow_while_a_row_is_looked_through():
    """The limit of a row is reached by k pairs at any time, also where groups are uneven, and no pair in reach is lost."""
    rng = np.random.default_rng(5)
    for n, k in ((3, 5), (64, 1), (100, 4), (517, 30)):
        d = rng.random((20, n))
        d[rng.random(d.shape) < 0.1] = np.nan
        state = knn.Found(20, k)
        for to in range(0, n, 70):
            part = d[:, to:to + 70]
            state.look(0, to, part, part, 0.0)
            seen = np.sort(np.where(np.isnan(d[:, :to + 70]), np.inf, d[:, :to + 70]), axis=1)
            assert (state.limit >= (seen[:, k - 1] if seen.shape[1] >= k else np.inf)).all()
        got = set(zip(*map(np.ndarray.tolist, state.in_reach())))
        for r in range(20):
            best = [c for c in np.argsort(np.where(np.isnan(d[r]), np.inf, d[r]))[:k] if not np.isnan(d[r, c])]
            assert {(r, int(c)) for c in best} <= got


def test_row_copies_of_the_half_grid(spark, monkeypatch):
    """Half of what the whole grid makes; any two rows meet in one cell, and every row is on both sides of its own."""
    monkeypatch.setattr(knn, "SHARE", 4)
    assert {n: knn.half_grid(spark.range(n)).count() for n in (400, 6400)} == {400: 400 * 10, 6400: 6400 * 40}
    rows = knn.half_grid(spark.range(100)).toPandas()
    met = [(a, b) for _, cell in rows.groupby(["i", "j"]) for a in cell[cell["_a"]]["id"] for b in cell[cell["_b"]]["id"]]
    pairs = {(min(p), max(p)) for p in met}
    assert len(pairs) == 100 * 101 // 2 and len(met) == sum(len(c[c["_a"]]) * len(c[c["_b"]]) for _, c in rows.groupby(["i", "j"]))


def test_vectors_travel_as_they_are(spark, monkeypatch):
    """Single precision stays, and the closeness of copies and of rows without length is what it was."""
    monkeypatch.setattr(knn, "SHARE", 1)
    rows = [(i, [float(i % 3), 1.0, 0.5 * (i % 7)]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, [float("nan"), 1.0, 1.0]), (42, None)]
    df = spark.createDataFrame(rows, "track_id long, embedding array<float>")
    shipped, half = [], knn.half_grid
    monkeypatch.setattr(knn, "half_grid", lambda items, share=1: (shipped.append(dict(items.dtypes)), half(items, share))[1])
    got = similarity.closeness(similarity.cosine_topk(df, 3)).toPandas()
    assert shipped == [{"id": "bigint", "x": "array<float>"}]
    x = np.array([v for _, v in rows[:40]])
    d = 1 - (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(d, np.inf)
    assert set(got["seed"]) == set(range(40)) and (got.groupby("seed").size() == 3).all()
    for seed, part in got.groupby("seed"):
        assert np.allclose(np.sort(part["distance"]), np.sort(d[seed])[:3], atol=1e-7)
    same = similarity.cosine_topk(df, 3, seeds=df.select(F.col("track_id").alias("id")).where("id % 5 = 0")).toPandas()
    key = lambda p: sorted(zip(p["seed"], p["rank"], p["other"]))                                   # noqa: E731
    assert key(same) == [v for v in key(got) if v[0] % 5 == 0]
