"""Batch ingest into the play log and the catalogue, keyed merges and sinks."""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from earlog.functions.columns import col
from earlog.functions.text import canonical_artist
from earlog.operators import base
from earlog.sources.history import MUSIC_HEADER


def second_of(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def ingest_listens(new: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Entries to append: first per (item, second) in file order, minus those already stored.

    The first one is an aggregate, so duplicates are dropped before the shuffle.
    """
    order = F.struct(*[F.col(c) for c in ("file", "pos") if c in new.columns])
    entry = F.struct(*[F.col(c) for c in new.columns if c != "track_id"])
    unique = (new.groupBy("track_id", second_of("listened_at").alias("_sec"))
              .agg(F.min_by(entry, order).alias("_e")))
    if existing is not None:
        stored = existing.select("track_id", second_of("listened_at").alias("_sec"))
        unique = base.anti(unique, stored, ["track_id", "_sec"])
    return unique.select("track_id", "_e.*")


def upsert_tracks(tracks: DataFrame, batch: DataFrame) -> DataFrame:
    """Catalogue after a batch: last non-empty title and channel win, header is the last one."""
    order = F.struct(*[F.col(c) for c in ("file", "pos") if c in batch.columns])

    def last(c: str) -> Column:
        return F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", order))

    new = batch.groupBy("track_id").agg(
        last("title").alias("_title"), last("channel").alias("_channel"),
        F.max_by("header", order).alias("_header"),
        F.bool_or(F.col("header") == MUSIC_HEADER).alias("_app"))
    out = tracks.join(new, "track_id", "full_outer")
    channel = F.coalesce("_channel", "channel", F.lit(""))
    told = F.coalesce("_app", F.lit(False)) & F.col("is_music").isNull()
    touched = F.col("_header").isNotNull()
    return out.select(
        "track_id", F.coalesce("_title", "title", F.lit("")).alias("title"), channel.alias("channel"),
        F.when(touched & (channel != ""), canonical_artist(channel))
        .otherwise(F.coalesce("artist_canonical", F.lit(""))).alias("artist_canonical"),
        F.coalesce("_header", "header").alias("header"),
        F.when(told, True).otherwise(F.col("is_music")).alias("is_music"),
        F.when(told, "yt-music-app").otherwise(F.coalesce("music_reason", F.lit(""))).alias("music_reason"),
        *[c for c in tracks.columns if c not in ("track_id", "title", "channel", "artist_canonical", "header",
                                                 "is_music", "music_reason")])


def refresh_play_count(tracks: DataFrame, listens: DataFrame) -> DataFrame:
    n = listens.groupBy("track_id").agg(F.count(F.lit(1)).alias("_n"))
    return tracks.drop("play_count").join(n, "track_id", "left").withColumn(
        "play_count", F.coalesce("_n", F.lit(0))).drop("_n")


def import_summary(batch: DataFrame, tracks: DataFrame, listens: DataFrame) -> DataFrame:
    """Entries and distinct items of a batch, and the table sizes after it."""
    return batch.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("track_id").alias("items")).select(
        "entries", "items", tracks.agg(F.count(F.lit(1))).scalar().alias("tracks"),
        listens.agg(F.count(F.lit(1))).scalar().alias("listens"))


def merge_latest(stored: DataFrame, fetched: DataFrame, keys: list[str], ts: str = "fetched_at") -> DataFrame:
    """Upsert by key: the row with the newest time wins, the fetched one on equal times."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fetched.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    value = F.struct(*[F.col(c) for c in both.columns if c not in (*keys, "_new")])
    return both.groupBy(*keys).agg(F.max_by(value, F.struct(ts, "_new")).alias("_v")).select(*keys, "_v.*")


def publish(tables: dict[str, DataFrame], path: str) -> None:
    """Replace the tables under `path` together; a reader sees all the old ones or all the new ones.

    They are written to a folder of their own, and a line in the log makes that folder the current one. A job that fails before
    leaves the log as it was. Earlier versions stay for readers that are at work; dropping them is left to the storage's rules.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    seq = 1 + max((r["seq"] for r in _log(spark, path)), default=0)
    spark.createDataFrame([(seq, version)], _LOG).coalesce(1).write.mode("append").json(f"{path}/log")


_LOG = "seq bigint, version string"


def _log(spark: SparkSession, path: str) -> list:
    """Current version, or nothing when none was ever published."""
    try:
        log = spark.read.schema(_LOG).json(f"{path}/log")
    except AnalysisException:
        return []
    return log.orderBy(F.desc("seq"), F.desc("version")).limit(1).collect()


def published(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the current version; None when none was ever published."""
    current = _log(spark, path)
    return spark.read.parquet(f"{path}/{current[0]['version']}/{name}") if current else None


def write_edges(path: str, **edges: DataFrame) -> None:
    """Replace the edge tables of a build. Also written when empty, so 'never built' stays distinguishable."""
    publish(edges, path)


def write_clusters(clusters: DataFrame, labels: DataFrame, path: str) -> None:
    """Replace the cluster table (cluster_id, name, size and others) and who is in which (track_id, cluster_id)."""
    publish({"clusters": clusters, "labels": labels.select("track_id", "cluster_id").where(F.col("cluster_id").isNotNull())}, path)


def reset_marks(marks: DataFrame, path: str, items: DataFrame | None = None) -> int:
    """Forget marks (all, or those of `items`) and say how many; what is forgotten stays readable as `cleared`.

    The number is observed while the rows are written: the marks are not read again to count them.
    """
    seen = Observation()
    gone = marks if items is None else base.semi(marks, items.select("track_id").distinct())
    left = marks.limit(0) if items is None else base.anti(marks, items.select("track_id"))
    publish({"cleared": gone.observe(seen, F.count(F.lit(1)).alias("n")), "marks": left}, path)
    return seen.get.get("n", 0)


def write_listens(batch: DataFrame, path: str) -> None:
    """Append plays, one folder per month, so period filters skip whole folders."""
    (batch.withColumn("month", F.date_format("listened_at", "yyyy-MM"))
     .repartition("month", F.pmod(F.xxhash64("track_id"), F.lit(64)))
     .sortWithinPartitions("month", "listened_at")
     .write.mode("append").partitionBy("month").parquet(path))


def assign_clusters(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """Catalogue with the cluster of the latest run; items outside it lose theirs."""
    return tracks.drop("cluster_id").join(labels.select("track_id", "cluster_id"), "track_id", "left")


# ---- details of items -------------------------------------------------------------------
_ISO = r"^P(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"


def iso_seconds(text: Column | str) -> Column:
    """ISO-8601 duration to seconds; NULL when it is none."""
    t = F.coalesce(col(text), F.lit(""))
    parts = [F.coalesce(F.regexp_extract(t, _ISO, i).try_cast("bigint"), F.lit(0)) * w
             for i, w in ((1, 86400), (2, 3600), (3, 60), (4, 1))]
    return F.when(t.rlike(_ISO), (parts[0] + parts[1] + parts[2] + parts[3]).cast("double"))


def video_details(df: DataFrame) -> DataFrame:
    return df.select("track_id", iso_seconds("duration_iso").alias("duration"),
                     F.col("category_id").cast("string").try_cast("int").alias("category_id"), "channel", "title")
