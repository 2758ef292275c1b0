"""What similar tracks ship and leave on disk: texts in few bytes, whole texts once a pair, cells in waves, no old shuffle files."""
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from earlog import config as C
from earlog.operators import base, knn, similarity
from test_similar import items

SCHEMA = "track_id long, language string, term string, weight double"


def texts(n, rng, words=25):
    rows = []
    for i in range(n):
        terms = list(dict.fromkeys(["the", "of", *rng.choice([f"t{j}" for j in range(words)], 5)]))
        w = rng.random(len(terms)) + 0.1
        rows += [(i, "en", t, float(v)) for t, v in zip(terms, w / np.linalg.norm(w))]
    return rows


def test_whole_texts_of_given_pairs(spark):
    """Terms of an id add up, a pair that is given twice counts twice, as they did in a join by term."""
    rows = [*texts(30, np.random.default_rng(1)), (3, "fr", "the", 0.25), (3, "en", "of", 0.5)]
    pairs = [(i, j) for i in range(30) for j in range(0, 30, 7) if i != j] + [(1, 7), (1, 99)]
    got = similarity.text_products(spark.createDataFrame(pairs, "seed long, other long"), spark.createDataFrame(rows, SCHEMA))
    vec = {}
    for i, _, t, v in rows:
        vec.setdefault(i, {})[t] = vec.get(i, {}).get(t, 0.0) + v
    want = {(i, j): sum(v * vec[j].get(t, 0.0) for t, v in vec[i].items()) * pairs.count((i, j)) for i, j in pairs if j in vec}
    got = {(r.seed, r.other): r._dot for r in got.collect()}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p], abs=1e-12) for p in want)


def test_slim_texts_bound_the_text_distance(spark, monkeypatch):
    """Three bytes a place, and the bounds still enclose the distance: of listed pairs and of the quick look."""
    monkeypatch.setattr(similarity, "OWN_TERMS", 6)
    monkeypatch.setattr(similarity, "OTHER_TERMS", 4)
    rows = texts(30, np.random.default_rng(2))
    slim = similarity.slim_texts(similarity.text_bounds(spark.createDataFrame(rows, SCHEMA)))
    types = dict(slim.dtypes)
    assert types["text_at"] == "array<smallint>" and types["text_w"] == "array<tinyint>"
    text = slim.orderBy("track_id").toPandas()
    pdf = items(30, np.random.default_rng(8))[:30].assign(text_lang="en", **{c: text[c] for c in ("text_at", "text_w", "text_step")})
    pdf.loc[3, ["text_at", "text_w"]] = None
    measure = similarity.weighted_measure(C.TRACK_WEIGHTS, C.KEY_BONUS)
    a, b = measure.sides(pdf, pdf)
    r, c = (v.ravel() for v in np.indices((30, 30)))
    low, high, _, extra = measure.pairs(a, r, b, c)
    vec = [{t: v for i, _, t, v in rows if i == n} for n in range(30)]
    dot = np.array([sum(v * vec[j].get(t, 0.0) for t, v in vec[i].items()) for i, j in zip(r, c)])
    w = C.TRACK_WEIGHTS["lyrics"]
    whole = (extra["part"] + w * (1 - dot)) / (extra["full"] + w)
    assert (low <= whole).all() and (whole <= high).all()
    there = (r != 3) & (c != 3)
    assert ((high - low)[there] < 0.8 * w / (extra["full"] + w)[there]).mean() > 0.9
    fast = measure.screen(a, b)
    assert (np.abs(fast[0].ravel() - low) <= fast[2]).all() and (np.abs(fast[1].ravel() - high) <= fast[2]).all()


def test_waves_of_cells_give_the_same_tracks(spark, sf, monkeypatch):
    from earlog.plans import inputs as I
    from earlog.plans.textual import _topics
    monkeypatch.setattr(knn, "SHARE", 20)
    f, t, lyr = I.features(spark, sf), I.tracks(spark, sf), _topics(spark, sf)
    key = lambda df: [tuple(r) for r in df.orderBy("seed", "rank").collect()]                 # noqa: E731
    whole = key(similarity.similar_tracks(f, t, lyr, 3))
    monkeypatch.setattr(knn, "WAVE", 2)
    shipped, half = [], knn.half_grid
    monkeypatch.setattr(knn, "half_grid", lambda rows, share=1: (shipped.append(dict(rows.dtypes)), half(rows, share))[1])
    assert key(similarity.similar_tracks(f, t, lyr, 3)) == whole
    assert len(shipped) > 1 and shipped[0]["text_w"] == "array<tinyint>" and shipped[0]["embedding"] == "array<float>"


def test_stored_rows_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: manager.getAllFiles().size()                                             # noqa: E731
    df = spark.range(100000).groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("s"))
    before = files()
    rows = base.stored(df)
    end = time.time() + 20
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before and rows.count() == 5000
    assert spark.conf.get(base._CLEANUP, None) is None
