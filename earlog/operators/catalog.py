"""Catalogues over the library: genres, languages, keys, moods, clusters, artists."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from earlog import config as C
from earlog.functions.columns import artist
from earlog.functions.labels import genre_label
from earlog.operators import base
from earlog.operators.tracks import dominant_moods


def genres(features: DataFrame, top: int | None = 40, minimum: int = 3) -> DataFrame:
    """Items per genre: the most frequent ones (None: all), then only those with enough items."""
    counts = (features.filter(F.col("tags") != "").select(F.explode("genres.name").alias("name"))
              .groupBy("name").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "name"))
    best = counts if top is None else counts.limit(top)
    return best.filter(F.col("count") >= minimum).withColumn("label", genre_label("name"))


def languages(lyrics: DataFrame) -> DataFrame:
    real = (F.col("text") != "") & (F.col("source") != "whisper") & (F.col("language") != "")
    return (lyrics.filter(real).groupBy(F.col("language").alias("code"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "code"))


def keys(features: DataFrame, tracks: DataFrame) -> DataFrame:
    rows = features.filter(F.col("key") != "").select("track_id", "key")
    return (base.semi(rows, tracks.filter("is_music")).groupBy("key")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "key"))


def mood_counts(features: DataFrame) -> DataFrame:
    """Items per dominant mood, ties counted for each: eleven conditional counts in one pass."""
    sums = dominant_moods(features).agg(*[F.count_if(F.col("mood") == m).alias(m) for m in C.MOODS])
    return sums.unpivot([], C.MOODS, "name", "count")


def clusters(clusters_df: DataFrame) -> DataFrame:
    return clusters_df.orderBy(F.col("size").desc(), "cluster_id")


def cluster_cards(tracks: DataFrame, clusters_df: DataFrame, n: int = 15) -> DataFrame:
    """The n most played items of each cluster."""
    best = base.first_k(tracks.filter(F.col("cluster_id").isNotNull()), ["cluster_id"],
                        [F.col("play_count").desc(), F.col("track_id")], n, rank="rank")
    return best.join(clusters_df.select("cluster_id", "name", "size"), "cluster_id").select(
        "cluster_id", "name", "size", "rank", "track_id", "title", artist().alias("artist"), "play_count")


def artist_play_totals(tracks: DataFrame) -> DataFrame:
    """Plays per canonical artist over the music catalogue."""
    return (tracks.filter("is_music").groupBy(artist().alias("artist"))
            .agg(F.sum("play_count").alias("plays")).filter(F.col("artist") != ""))


def artists_view(artists: DataFrame, q: str = "", sort: str = "plays", order: str = "desc") -> DataFrame:
    """Artist list with a substring filter; ascending or descending by one of five columns."""
    term = q.strip().lower()
    rows = artists.filter(F.contains(F.lower("artist"), F.lit(term))) if term else artists
    by = {"channel": ["artist"], "genre": ["genre", "artist"], "tracks": ["tracks"],
          "last_listen": ["last_listen"]}.get(sort, ["plays"])
    cols = [F.coalesce("genre", F.lit("")) if c == "genre" else F.col(c) for c in by]
    direction = [c.asc() if order == "asc" else c.desc() for c in cols]
    return rows.orderBy(*direction, F.col("artist").asc())


def analyzed_options(features: DataFrame, tracks: DataFrame) -> DataFrame:
    """Analysed items, newest first, as choices for a seed."""
    return (features.select("track_id", "analyzed_at")
            .join(tracks.select("track_id", "title", "channel", artist().alias("artist"), "play_count"), "track_id")
            .orderBy(F.col("analyzed_at").desc(), "track_id"))
