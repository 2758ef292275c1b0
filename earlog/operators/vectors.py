"""Feature vectors: assembly, shrinkage, standardisation, sparse and text vectors, column distances."""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from earlog import config as C
from earlog.functions.columns import let
from earlog.operators import base


def raw_vectors(features: DataFrame) -> DataFrame:
    """Usable audio rows with their 53 numbers as `vec`; other columns are kept."""
    ok = ((F.col("source") == "audio") & (F.col("feat_version") >= C.SIMILARITY_VERSION)
          & F.col("mfcc").isNotNull() & F.col("chroma").isNotNull() & F.col("contrast").isNotNull())
    rhythm = F.array(F.log1p("tempo"), F.col("danceability"), F.coalesce("percussive", F.lit(0.5)))
    macro = F.array(F.col("energy"), F.col("acousticness"), F.col("brightness"),
                    F.coalesce("dynamics", F.lit(0.0)), F.coalesce("loudness", F.lit(-20.0)) / 45.0)
    return features.filter(ok).withColumn("vec", F.concat("mfcc", "chroma", "contrast", rhythm, macro))


def mean_vector(c: str) -> Column:
    """Element-wise mean as a mergeable aggregate: partial sums before any shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(c))))


def shrink_to_artist(vectors: DataFrame, tracks: DataFrame, k: float = C.SHRINKAGE) -> DataFrame:
    """Pulls each vector towards the mean of its channel, less so for channels with many items."""
    rows = vectors.join(tracks.select("track_id", "channel"), "track_id", "left")
    means = (rows.filter(F.coalesce("channel", F.lit("")) != "").groupBy("channel")
             .agg(mean_vector("vec").alias("_mean"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2))
    alpha = F.col("_n") / (F.col("_n") + k)
    pulled = F.zip_with("vec", "_mean", lambda v, m: alpha * v + (1 - alpha) * m)
    return rows.join(means, "channel", "left").withColumn("vec", F.coalesce(pulled, "vec")).drop("_mean", "_n")


def standardize(vectors: DataFrame, c: str = "vec") -> DataFrame:
    """Zero mean and unit population deviation per element as `z`; a constant element becomes 0.

    The statistics are one aggregate read back as a scalar subquery, so rows are not shuffled.
    """
    v = array_to_vector(F.col(c))
    summary = vectors.agg(vector_to_array(Summarizer.mean(v)).alias("mean"), vector_to_array(Summarizer.variance(v)).alias("var"),
                          F.count(F.lit(1)).alias("n"))
    factor = (F.col("n") - 1) / F.col("n")
    stats = summary.select(F.struct("mean", F.transform("var", lambda x: F.when(x > 0, F.sqrt(x * factor)).otherwise(1.0))
                                    .alias("std")).alias("s")).scalar()
    def scaled(s: Column) -> Column:
        return F.zip_with(F.zip_with(c, s["mean"], lambda a, m: a - m), s["std"], lambda a, d: a / d)
    # bound to a name: the optimizer would otherwise write the subquery out once for every use
    return vectors.withColumn("_s", stats).withColumn("z", let(F.col("_s"), scaled)).drop("_s")


def split_groups(df: DataFrame) -> DataFrame:
    return df.withColumns({g: F.slice("z", s + 1, e - s) for g, (s, e) in C.DENSE_SLICES.items()})


def cluster_space_features(features: DataFrame) -> DataFrame:
    """Standardised groups times the square root of their weight, without shrinkage."""
    z = standardize(raw_vectors(features))

    def block(v: Column, group: str) -> Column:
        (s, e), scale = C.DENSE_SLICES[group], C.CLUSTER_WEIGHTS[group] ** 0.5
        return F.transform(F.slice(v, s + 1, e - s), lambda x: x * scale)

    def point(v: Column) -> Column:
        return F.concat(*[block(v, g) for g in C.CLUSTER_WEIGHTS])
    return z.select("track_id", let(F.col("z"), point).alias("point"))


def cluster_space_embedding(features: DataFrame) -> DataFrame:
    """Embeddings scaled to unit length, the length floored."""
    rows = features.filter((F.col("source") == "audio") & F.col("embedding").isNotNull())
    v = F.transform("embedding", lambda x: x.cast("double"))
    unit = let(v, lambda a: F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(1e-9))))
    return rows.select("track_id", unit.alias("point"))


# ---- distances of two columns ---------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_dist(a: Column, b: Column) -> Column:
    """1 − cosine of two arrays; NULL when one has no length."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def sparse_cosine(a: Column, b: Column) -> Column:
    """1 − cosine of two maps; NULL when one is empty or has no length."""
    shared = F.aggregate(F.map_entries(a), F.lit(0.0),
                         lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    return 1 - shared / F.nullif(norm(F.map_values(a)) * norm(F.map_values(b)), F.lit(0.0))


# ---- text vectors -----------------------------------------------------------------------------------
_FIRST = 1 << 40


def tfidf(lyrics: DataFrame, vocabulary: int | None = C.VOCABULARY_SIZE) -> DataFrame:
    """track_id, language, term, weight: unit-length TF-IDF rows, one vocabulary per language.

    Terms are runs of two or more word characters; the vocabulary is the most frequent terms (ties by term; None: all); idf =
    ln((1 + n) / (1 + df)) + 1. Languages with a single text are left out.

    Texts move once, by item, and are cut into terms where they lie. Counts of (text, term) carry one number, the term's count plus a
    mark on one row of each text, so that texts per language come from the same rows. The vocabulary is stored, so that its size is
    known when weights are planned: counts stay where they are while Spark finds it small enough to send, and are shuffled otherwise.
    """
    texts = lyrics.filter((F.col("text") != "") & (F.col("source") != "whisper")).select(
        "track_id", F.coalesce(F.nullif("language", F.lit("")), F.lit("en")).alias("language"), "text").repartition("track_id")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    # the outer form keeps texts without a term, which count as texts
    rows = texts.select("track_id", "language", F.posexplode_outer(tokens).alias("pos", "term"))
    mark = F.when(F.coalesce("pos", F.lit(0)) == 0, _FIRST).otherwise(0) + F.when(F.col("term").isNotNull(), 1).otherwise(0)
    # '' stands for no term: a key without NULLs, and tests of counts instead of keys, keep filters above the shared exchange
    tf = rows.groupBy("track_id", "language", F.coalesce("term", F.lit("")).alias("term")).agg(F.sum(mark.cast("bigint")).alias("m"))
    count = F.col("m").bitwiseAND(F.lit(_FIRST - 1))
    terms = tf.groupBy("language", "term").agg(F.sum(count).alias("total"), F.count(F.lit(1)).alias("df"),
                                               F.sum(F.shiftright("m", 40)).alias("firsts"))
    sizes = terms.groupBy("language").agg(F.sum("firsts").alias("n")).filter(F.col("n") >= 2)
    real = terms.filter(F.col("total") > 0)
    kept = real if vocabulary is None else base.first_k_salted(
        real, ["language"], [F.col("total").desc(), F.col("term")], vocabulary, "term")
    idf = kept.join(sizes, "language").select("language", "term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(base.stored(idf), ["language", "term"]).withColumn("w", count * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("track_id")))      # a text has at most the vocabulary
    return weighted.select("track_id", "language", "term", (F.col("w") / length).alias("weight"))


def text_vectors(weights: DataFrame) -> DataFrame:
    """TF-IDF rows as one map per item, at most the vocabulary long."""
    return weights.groupBy("track_id").agg(F.first("language").alias("text_lang"), F.map_from_entries(
        F.collect_list(F.struct("term", "weight"))).alias("text_vec"))


def usable_texts(usable: DataFrame, lyrics: DataFrame) -> DataFrame:
    """Texts of usable rows; transcripts are left out."""
    return base.semi(lyrics.filter(F.col("source") != "whisper"), usable.select("track_id"))


def text_weights(usable: DataFrame, lyrics: DataFrame) -> DataFrame:
    """TF-IDF rows whose vocabularies are learned from the usable rows' texts only."""
    return tfidf(usable_texts(usable, lyrics))


def text_facts(usable: DataFrame, lyrics: DataFrame) -> DataFrame:
    """track_id, topics of the usable rows' texts."""
    topics = F.col("topics") if "topics" in lyrics.columns else F.create_map().cast("map<string,double>").alias("topics")
    return usable_texts(usable, lyrics).select("track_id", topics)


def semantic_features(usable: DataFrame, lyrics: DataFrame) -> DataFrame:
    """genre_vec, instrument_vec, moodtags of each usable row plus topics and text vector."""
    return (usable.select("track_id", "genre_vec", "instrument_vec", "moodtags")
            .join(text_facts(usable, lyrics), "track_id", "left").join(text_vectors(text_weights(usable, lyrics)), "track_id", "left"))
