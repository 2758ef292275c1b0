"""Base relations: plays of music items, pre-aggregated before any join.

The fact table is first reduced to one row per (item, bucket) with a map-side combine. A single
item with a third of all plays therefore never travels through a join as raw rows, and the join
to the catalogue runs on counts.
"""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from earlog import config as C
from earlog.functions.columns import artist, in_period
from earlog.session import ensure_checkpoint_dir


def music_listens(listens: DataFrame, tracks: DataFrame, d_from=None, d_to=None) -> DataFrame:
    """Raw plays of items judged to be music."""
    music = tracks.filter("is_music").select("track_id")
    return listens.filter(in_period("listened_at", d_from, d_to)).join(music, "track_id", "left_semi")


def play_counts(listens: DataFrame, d_from: dt.date | None = None, d_to: dt.date | None = None,
                **buckets: Column) -> DataFrame:
    """One row per item (and bucket): n plays, first and last play."""
    keys = [F.col("track_id")] + [e.alias(name) for name, e in buckets.items()]
    return (listens.filter(in_period("listened_at", d_from, d_to)).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.min("listened_at").alias("first_at"),
                 F.max("listened_at").alias("last_at")))


def music_counts(listens: DataFrame, tracks: DataFrame, d_from=None, d_to=None,
                 **buckets: Column) -> DataFrame:
    """`play_counts` joined to the music catalogue, with the canonical artist."""
    music = tracks.filter("is_music").select(
        "track_id", "title", "channel", "duration", artist().alias("artist"))
    return play_counts(listens, d_from, d_to, **buckets).join(music, "track_id")


def feature_counts(listens, tracks, features, d_from=None, d_to=None, **buckets) -> DataFrame:
    """Counts of music items that have audio features."""
    return music_counts(listens, tracks, d_from, d_to, **buckets).join(
        features.drop("title", "channel", "duration", "artist"), "track_id")


def lyrics_counts(listens, tracks, lyrics, d_from=None, d_to=None, **buckets) -> DataFrame:
    """Counts of music items with a real text (transcripts left out)."""
    real = lyrics.filter((F.col("text") != "") & (F.col("source") != "whisper")).select("track_id", "language")
    return music_counts(listens, tracks, d_from, d_to, **buckets).join(real, "track_id")


def period_bounds(d_from, d_to, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Effective period; thirty days ending at `as_of` by default."""
    end = d_to or as_of
    return d_from or end - dt.timedelta(days=29), end


def prev_bounds(d_from, d_to, as_of: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """Period of the same length directly before; none when the start is open."""
    if d_from is None:
        return None, None
    length = ((d_to or as_of) - d_from).days + 1
    return d_from - dt.timedelta(days=length), d_from - dt.timedelta(days=1)


def preset_range(name: str, as_of: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """Named period ending at `as_of`; 'all' is unbounded."""
    starts = {"7d": as_of - dt.timedelta(days=6), "30d": as_of - dt.timedelta(days=29),
              "month": as_of.replace(day=1), "year": as_of.replace(month=1, day=1)}
    return (starts[name], as_of) if name in starts else (None, None)


def check_period(d_from, d_to) -> None:
    if d_from and d_to and d_from > d_to:
        raise ValueError("the period ends before it starts")


def semi(df: DataFrame, keys: DataFrame, on="track_id") -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on="track_id") -> DataFrame:
    return df.join(keys, on, "left_anti")


def top_k(df: DataFrame, score: str, ident: str, k: int, by: list[str] | None = None,
          rank: str | None = None) -> DataFrame:
    """Best k rows by score, ties by id; per group with `by`.

    Grouped form: the rank filter is pushed below the shuffle, so a hot group sends at most k rows
    per map task.
    """
    order = [F.col(score).desc(), F.col(ident)]
    if not by:
        return df.orderBy(*order).limit(k)
    return first_k(df, by, order, k, rank)


def first_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    name = rank or "_rank"
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_k_salted(df: DataFrame, by: list[str], order: list[Column], k: int, salt_on: str,
                   salts: int = 64, rank: str = "rank") -> DataFrame:
    """`first_k` in two steps for large k, where the rank filter is not pushed down.

    Every member of the final top k is in the top k of its own salt, so the result is exact while
    the largest sort holds a 1/salts part of a hot group.
    """
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    full = Window.partitionBy(*by).orderBy(*order)
    return (df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
            .withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k)
            .withColumn(rank, F.row_number().over(full)).filter(F.col(rank) <= k)
            .drop("_salt", "_r"))


def seconds_or_default(duration: Column, default: float = C.UNKNOWN_DURATION_S) -> Column:
    return F.coalesce(duration, F.lit(default))


def spread(df: DataFrame) -> DataFrame:
    """More tasks for a scan with fewer splits than cores; a scan that has enough stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Spark's switch for dropping the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder and read back: joins with them are planned by their size.

    What was shuffled for them is dropped, as only the rows are read again.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
