"""What moves between tasks: plans of queries whose rows would otherwise be shuffled whole, and the same rows where nothing is sent."""
import numpy as np
import pandas as pd
import pytest

from earlog.operators import knn, similarity, texts
from earlog.plans.registry import load

TABLE = load()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, keys", [("tfidf", ("language", "term")), ("text_dist", ("track_id", "lang")), ("detect_language", ("gram",)),
                                        ("derive_texts", ("gram",)), ("external_similar", ("l_orderkey",)), ("external_seed_meta", ("l_orderkey",))])
def test_rows_stay(name, keys, spark, sf):
    """Joins and groups of the whole table find their rows where one exchange has put them."""
    import re
    moved = re.findall(r"hashpartitioning\(([^()]*?), \d+\)", _plan(TABLE[name][0](spark, sf)))
    named = {tuple(re.sub(r"#\d+L?", "", k).strip() for k in m.split(",")) for m in moved}
    assert named and not any(n[:len(keys)] == keys for n in named), named


def test_matcher_runs_once_a_ratio(spark, sf):
    assert _plan(TABLE["best_match"][0](spark, sf)).count("ArrowEvalPython") == 2


@pytest.mark.parametrize("name", ["tfidf", "detect_language"])
def test_same_rows_shuffled(name, spark, sf):
    """A vocabulary or profile too large to send is joined by shuffles, with the same rows."""
    sent = sorted(map(tuple, TABLE[name][0](spark, sf).collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, TABLE[name][0](spark, sf).collect()), key=repr) == sent
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_best_match_order(spark):
    """The song alone decides only where no pair reaches the ratio; equal ratios go by position."""
    terms = spark.createDataFrame([(1, "abc", "one two"), (2, "zzzzzzzzzzzz", "one two"), (3, "q", "")], "track_id long, artist string, song string")
    cand = spark.createDataFrame([(1, 2, "abc", "one two", 12), (1, 1, "abd", "one two", 11), (1, 0, "x", "one two", 10), (2, 5, "yyyyyyyyyyyy", "one two", 25),
                                  (2, 4, "yyyyyyyyyyyy", "one two", 24), (2, 3, "y", "other", 23), (3, 0, "q", "", 30)],
                                 "track_id long, pos long, cand_artist string, cand_song string, cand_id long")
    got = {r.track_id: (r.cand_id, r.ratio, r.confirmed) for r in texts.best_match(terms, cand).collect()}
    assert got == {1: (12, 1.0, True), 2: (24, 1.0, True)}


def test_distance_blocks_are_small():
    """One matrix of a cell holds at most 8 MB, however many rows the cell has."""
    seen = []
    measure = similarity.cosine_measure()
    watched = knn.Measure(lambda a, b: (seen.append(len(a) * len(b)), measure.bounds(a, b))[1], cells=measure.cells)
    rows = pd.DataFrame({"id": range(3000), "x": list(np.random.default_rng(1).normal(size=(3000, 4)))})
    assert len(knn.block(rows, rows, watched, 2)) == 6000 and max(seen) * 8 <= 8 << 20
