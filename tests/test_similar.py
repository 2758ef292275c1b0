"""Cells of the grid by a quick look: the same pairs as by whole matrices, and few pairs compared number by number."""
import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from earlog import config as C
from earlog.operators import knn, similarity


def maps(rng, n, names, size):
    return [{k: float(rng.random()) for k in rng.choice(list(names), size, replace=False)} if rng.random() > 0.2 else [None, {}][i % 2]
            for i in range(n)]


def items(n, rng, copies=0):
    """Rows as the grid ships them, some parts missing, some rows with the numbers of another."""
    z = rng.normal(size=(n, 53))
    z[::17, 47] = np.nan
    pdf = pd.DataFrame({
        "id": np.arange(n), "x": list(z), "key": rng.choice(["C major", "A minor", "", None], n), "mode_conf": rng.random(n),
        "embedding": [None if i % 19 == 0 else v for i, v in enumerate(rng.normal(size=(n, 8)))],
        "mood_v": list(rng.random((n, 11)) * (rng.random((n, 1)) > 0.1)), "moodtags": maps(rng, n, "abcdefgh", 3),
        "genre_vec": maps(rng, n, "ijklmnop", 2), "instrument_vec": maps(rng, n, "qrstuv", 2), "topics": maps(rng, n, "wxyz", 1),
        "genre_list_vec": maps(rng, n, "ijklmnop", 2), "tag_vocal": np.rint(rng.random(n) * 8) / 8,
        "text_lang": rng.choice(["en", "fr", None], n)})
    again = pdf.iloc[:copies].assign(id=np.arange(n, n + copies))
    return pd.concat([pdf, again, pdf.iloc[:3]], ignore_index=True)


MEASURES = {"tracks": lambda: similarity.weighted_measure(C.TRACK_WEIGHTS, C.KEY_BONUS),
            "artists": lambda: similarity.weighted_measure(C.ARTIST_WEIGHTS, 0.0), "tags": similarity.tag_measure}


def by_pair(measure, a, b, k):
    return knn.block(a, b, measure, k).sort_values(["seed", "other", "low"]).reset_index(drop=True)


@pytest.mark.parametrize("name", list(MEASURES))
@pytest.mark.parametrize("copies", [0, 60])
def test_cells_by_a_quick_look(name, copies, monkeypatch):
    rng = np.random.default_rng(5)
    rows = items(400, rng, copies)
    rows["x"] = rows["mood_v"] if name == "tags" else rows["x"]
    measure = MEASURES[name]()
    plain = dataclasses.replace(measure, sides=None)
    monkeypatch.setattr(knn, "QUICK", 4000)
    monkeypatch.setattr(knn, "PAIRS", 50)
    for a, b, k in ((rows, rows, 3), (rows[:7], rows, 1), (rows, rows[:2], 3), (rows[:5], rows[:0], 2)):
        got, want = by_pair(measure, a, b, k), by_pair(plain, a, b, k)
        assert got[["seed", "other"]].values.tolist() == want[["seed", "other"]].values.tolist()
        for c in ("low", "high", *measure.extra):
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-6)
    monkeypatch.setattr(similarity, "WIDE", 3)                          # too many keys for matrices: the plain way
    assert by_pair(measure, rows, rows, 3).equals(by_pair(plain, rows, rows, 3))


@pytest.mark.parametrize("name", list(MEASURES))
def test_few_pairs_are_compared_number_by_number(name):
    rows = items(1500, np.random.default_rng(6))
    rows["x"] = rows["mood_v"] if name == "tags" else rows["x"]
    measure, seen = MEASURES[name](), []

    def pairs(a, r, b, c):
        seen.append(len(r))
        return measure.pairs(a, r, b, c)
    knn.block(rows, rows, dataclasses.replace(measure, pairs=pairs), 6)
    assert 6 * 1500 <= sum(seen) < 1500 * 1500 / 10


def test_text_bounds_hold_the_text_distance(spark, monkeypatch):
    """Bounds of the text part enclose it and are narrower than 0 to 1; also where one item has texts in two languages."""
    monkeypatch.setattr(similarity, "OWN_TERMS", 6)
    monkeypatch.setattr(similarity, "OTHER_TERMS", 4)
    rng, rows = np.random.default_rng(7), []
    for i in range(30):
        terms = list(dict.fromkeys(["the", "of", *rng.choice([f"t{j}" for j in range(25)], 5)]))
        w = rng.random(len(terms)) + 0.1
        rows += [(i, "fr" if i == 4 and j % 2 else "en", t, float(v)) for j, (t, v) in enumerate(zip(terms, w / np.linalg.norm(w)))]
    kept = similarity.text_bounds(spark.createDataFrame(rows, "track_id long, language string, term string, weight double"))
    text = kept.orderBy("track_id").toPandas()
    pdf = items(30, np.random.default_rng(8))[:30].assign(text_lang="en", text_at=text["text_at"], text_w=text["text_w"])
    measure = similarity.weighted_measure(C.TRACK_WEIGHTS, C.KEY_BONUS)
    a, b = measure.sides(pdf, pdf)
    r, c = (v.ravel() for v in np.indices((30, 30)))
    low, high, _, extra = measure.pairs(a, r, b, c)
    vec = [{t: v for i, _, t, v in rows if i == n} for n in range(30)]
    dot = np.array([sum(v * vec[j].get(t, 0.0) for t, v in vec[i].items()) for i, j in zip(r, c)])
    w = C.TRACK_WEIGHTS["lyrics"]
    whole = (extra["part"] + w * (1 - dot)) / (extra["full"] + w)
    assert (low <= whole).all() and (whole <= high).all() and (high - low < 0.8 * w / (extra["full"] + w)).mean() > 0.9


def test_text_weights_meet_few_pairs(spark, sf, monkeypatch):
    """Pairs left for the whole texts: not many more than the k that are asked for."""
    from earlog.plans import inputs as I
    from earlog.plans.textual import _topics
    left, reach = [], knn.within_reach
    monkeypatch.setattr(similarity, "within_reach", lambda pairs, k: (left.append(reach(pairs, k)), left[0])[1])
    similarity.similar_tracks(I.features(spark, sf), I.tracks(spark, sf), _topics(spark, sf), 3)
    rows = left[0].agg(F.count(F.lit(1)), F.countDistinct("seed")).first()
    assert rows[1] > 100 and rows[0] < 4 * rows[1]


def test_texts_of_repeated_ids_keep_the_wide_bounds():
    """Without places of its terms a row's text can be anything between 0 and 1."""
    pdf = items(4, np.random.default_rng(9))[:4].assign(text_lang="en", text_at=[None, np.array([0]), np.array([0]), None],
                                                        text_w=[None, np.array([1.0]), np.array([1.0]), None])
    a, b = (measure := MEASURES["tracks"]()).sides(pdf, pdf)
    low, high, _, extra = measure.pairs(a, np.array([0, 1, 0]), b, np.array([1, 2, 3]))
    gap = (high - low) * (extra["full"] + C.TRACK_WEIGHTS["lyrics"]) / C.TRACK_WEIGHTS["lyrics"]
    assert gap == pytest.approx([1, 0, 1], abs=1e-4)
