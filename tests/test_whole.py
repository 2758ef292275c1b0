"""Nothing is narrowed before the operator sees it: small tables with known results."""
import math

import duckdb
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from earlog.operators import texts
from earlog.plans import inputs, textual
from earlog.plans.registry import load

TABLE = load()


def test_texts_unchanged(spark, tmp_path):
    spark.createDataFrame([(1, "Oh no", "en", "src0", 5), (2, "", "en", "src0", 0), (3, None, None, "src1", None), (4, "hey", "fr", "src1", 3)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.track_id: (r.text, r.language, r.source) for r in inputs.lyrics(spark, str(tmp_path)).collect()}
    assert got == {1: ("Oh no", "en", "whisper"), 2: ("", "en", "none"), 3: (None, "", "none"), 4: ("hey", "fr", "lrclib")}

def test_frames_of_a_head(spark, sf):
    rows = textual._model_scores(spark, sf).groupBy("track_id", "head").agg({"frame": "max", "score": "count"}).select(
        "head", "max(frame)", "count(score)").distinct().collect()
    assert {tuple(r) for r in rows} == {("style", 4, 64), ("instrument", 7, 64), ("theme", 6, 64), ("vocal", 31, 64), ("dance", 31, 64),
                                        ("tone", 31, 64)}


def test_tag_lists_fallback(spark, tmp_path):
    rows = [("A", n, "LARGE") for n in "fedcbaf"] + [("B", None, "SMALL"), ("B", "", "PROMO"), ("B", "", "PROMO"), ("C", "x", ""), ("D", None, "")]
    spark.createDataFrame([(*r, 1) for r in rows], "p_brand string, p_name string, p_type string, p_size long").write.parquet(
        f"{tmp_path}/part.parquet")
    got = {r.artist: (r.top5, r.top1) for r in TABLE["artist_tag_lists"][0](spark, str(tmp_path)).collect()}
    assert got == {"A": ("f|a|b|c|d", "f"), "B": ("PROMO|SMALL", "PROMO"), "C": ("x", "x"), "D": ("", None)}


def test_profiles_keep_every_gram(spark):
    text = " ".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(600))
    rows = spark.createDataFrame([("en", text), ("fr", "ab")], "language string, text string")
    got = {(r.language, r.gram): r.logp for r in texts.language_profiles(rows).collect()}
    padded = f" {text} "
    grams = [padded[i:i + 3] for i in range(len(padded) - 2)]
    assert len(set(grams)) > 400 and {g for k, g in got if k == "en"} == set(grams)
    assert got["fr", " ab"] == pytest.approx(math.log(2 / 4))


def test_second_page(spark):
    """The smallest tables have no second page of 200 rows; these have."""
    sf = "/root/testdata/sf0.01"
    fn, sql = TABLE["tracks_query"]
    assert compare(fn(spark, sf), sql, connect(sf)) == ""


@pytest.mark.parametrize("name", ["cosine_dist", "sparse_cosine", "pair_match"])
def test_pairs_across_gaps(name, spark, sf, tmp_path):
    """Each vector meets the one before it of its label, also where ids have gaps, ranges are left and ids or labels repeat or are missing."""
    near = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id * 30011 AS vec_id", "label", "embedding")
    plain = name == "cosine_dist"                                            # maps have no place for null names, nor their SQL for repeated ids
    odd = near.limit(3 if plain else 0).union(near.limit(40).selectExpr("vec_id + 7", "CAST(NULL AS INT)" if plain else "label", "embedding")).union(
        near.limit(2).selectExpr("CAST(NULL AS BIGINT)", "label", "embedding"))
    near.union(odd).write.parquet(f"{tmp_path}/embeddings.parquet")
    fn, sql = TABLE[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    out = "similarity" if name == "pair_match" else "distance"
    got = fn(spark, str(tmp_path)).withColumn(out, F.col(out) + 0.0)         # one zero, as repeated rows are compared in text order
    assert compare(got, f"SELECT * REPLACE ({out} + 0.0::DOUBLE AS {out}) FROM ({sql})", con) == ""
