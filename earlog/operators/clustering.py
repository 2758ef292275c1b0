"""k-means groups of items, their quality and their names."""
from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from earlog import config as C
from earlog.functions.columns import rounded
from earlog.operators import vectors as V
from earlog.session import ensure_checkpoint_dir

MAX_CLUSTERS, RESTARTS, SEED, FAST_TEMPO = 8, 10, 42, 120.0


def eligible_rows(features: DataFrame) -> DataFrame:
    """Really analysed rows; estimates from metadata are left out."""
    return features.filter(F.col("source") == "audio")


def cluster_space(features: DataFrame, embedding: bool = False) -> DataFrame:
    rows = eligible_rows(features)
    return V.cluster_space_embedding(rows) if embedding else V.cluster_space_features(rows)


def cluster_tracks(space: DataFrame, k: int = MAX_CLUSTERS, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """track_id, point, cluster_id: best of several k-means runs; all ids NULL with fewer than two rows.

    Only centres reach the driver. The points are written once for all runs.
    """
    ensure_checkpoint_dir(space.sparkSession)
    points = space.withColumn("features", array_to_vector("point")).checkpoint()
    n = points.count()
    if n < 2:
        return points.select("track_id", "point", F.lit(None).cast("int").alias("cluster_id"))
    best = None
    for i in range(restarts):
        model = KMeans(k=max(1, min(k, n)), seed=seed + i, featuresCol="features", predictionCol="cluster_id").fit(points)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(points)


def silhouette(clustered: DataFrame, point: str = "point") -> DataFrame:
    """cluster_id, size, silhouette: mean silhouette of each group in squared Euclidean distance, and `overall` of all rows.

    The mean squared distance of a row to a group follows from the group's size, mean and mean square, so one aggregate over the
    rows and one pass with its few results are enough: every row counts, none is sampled. A group of one row has 0; with a single
    group the value is NULL.
    """
    rows = clustered.filter(F.col("cluster_id").isNotNull()).select("cluster_id", F.col(point).alias("_x"))
    rows = rows.withColumn("_q", V.dot(F.col("_x"), F.col("_x")))
    groups = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg("_q").alias("q"), V.mean_vector("_x").alias("m"))
    table = groups.agg(F.collect_list(F.struct("cluster_id", "n", "q", "m"))).scalar()          # one entry a group

    def far(g):
        return F.greatest(F.lit(0.0), F.col("_q") + g["q"] - 2 * V.dot(F.col("_x"), g["m"]))
    own = F.col("cluster_id")
    inner = F.transform(F.filter("_g", lambda g: (g["cluster_id"] == own) & (g["n"] > 1)), lambda g: far(g) * g["n"] / (g["n"] - 1))
    outer = F.array_min(F.transform(F.filter("_g", lambda g: g["cluster_id"] != own), far))
    rows = rows.withColumn("_g", table).select("cluster_id", F.get(inner, F.lit(0)).alias("a"), outer.alias("b"))
    s = F.when(F.col("a").isNull(), F.when(F.col("b").isNotNull(), 0.0)).otherwise(
        F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(F.when(F.col("b").isNotNull(), 0.0)))
    means = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg(s).alias("silhouette"))
    every = Window.partitionBy()                                                               # over the few groups
    return means.withColumn("overall", F.sum(F.col("silhouette") * F.col("size")).over(every) / F.sum("size").over(every))


def cluster_profile(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Per cluster: size, mean moods, mean tempo of rows that have one."""
    tempo = F.avg(F.when(F.col("tempo") > 0, F.col("tempo")))
    return (labels.filter(F.col("cluster_id").isNotNull()).select("track_id", "cluster_id")
            .join(features.select("track_id", "tempo", *C.MOOD_COLS), "track_id").groupBy("cluster_id")
            .agg(F.count(F.lit(1)).alias("size"), tempo.alias("tempo"), *[F.avg(c).alias(c) for c in C.MOOD_COLS]))


def cluster_names(profile: DataFrame) -> DataFrame:
    """cluster_id, name, size, mean moods.

    The name of the largest mean mood; where an earlier group has it, the tempo is added, then the next moods in turn. Names
    depend on each other, so the groups (few: the k of the run) are folded in order in one row.
    """
    moods = F.array(*[F.struct((-F.col(c)).alias("mean"), F.lit(i).alias("i"), F.lit(n).alias("name"))
                      for i, (n, c) in enumerate(zip(C.CLUSTER_NAMES, C.MOOD_COLS))])
    ranked = F.transform(F.array_sort(moods), lambda e: e["name"])
    word = F.when(F.col("tempo").isNull(), "part").when(F.col("tempo") >= FAST_TEMPO, "fast").otherwise("slow")
    first = profile.withColumn("_r", ranked).withColumn("_long", F.concat(F.col("_r")[0], F.lit(" · "), word))
    choices = F.concat(F.array(F.col("_r")[0], F.col("_long")), F.transform(F.slice("_r", 2, len(C.MOODS) - 1), lambda n: F.concat(F.col("_long"), F.lit(" · "), n)))
    first = first.withColumn("_c", choices).withColumn("_mix", F.concat(F.col("_long"), F.lit(" · mix")))
    rows = first.groupBy().agg(F.sort_array(F.collect_list(F.struct("cluster_id", "_c", "_mix", "size", *C.MOOD_COLS))).alias("xs"))

    def step(used, x):
        free = F.filter(x["_c"], lambda c: ~F.array_contains(used, c))
        return F.concat(used, F.array(F.coalesce(F.get(free, F.lit(0)), x["_mix"])))
    names = F.aggregate("xs", F.array().cast("array<string>"), step)
    out = rows.select(F.explode(F.arrays_zip("xs", names.alias("name"))).alias("e")).select("e.xs.*", "e.name")
    return out.select("cluster_id", "name", "size", *[rounded(c, 3).alias(c) for c in C.MOOD_COLS])
