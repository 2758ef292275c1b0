"""Listening statistics. Every function returns a lazy DataFrame."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from earlog import config as C
from earlog.functions.columns import artist, bucket, hour_label, in_period, percent_change, ratio, rounded
from earlog.operators import base


def _hours() -> Column:
    return rounded(F.coalesce(F.sum(F.col("n") * base.seconds_or_default(F.col("duration"))) / 3600,
                              F.lit(0.0)), 1)


def _total_plays(listens, tracks, d_from, d_to) -> Column:
    """All music plays of the period as a scalar subquery."""
    return base.play_counts(listens, d_from, d_to).join(
        tracks.filter("is_music").select("track_id"), "track_id", "left_semi").agg(
        F.coalesce(F.sum("n"), F.lit(0))).scalar()


def totals(listens, tracks, features, d_from=None, d_to=None) -> DataFrame:
    """Size of the library and the history in one row."""
    per_track = base.music_counts(listens, tracks, d_from, d_to)
    heard = F.count(F.lit(1))
    if d_from is None and d_to is None:
        n_all = tracks.agg(F.count(F.lit(1))).scalar()
        n_music = tracks.agg(F.count_if("is_music")).scalar()
    else:
        n_all = n_music = None
    out = per_track.agg(
        heard.alias("heard"), F.coalesce(F.sum("n"), F.lit(0)).alias("music_listens"),
        _hours().alias("hours_est"), F.min("first_at").alias("first_listen"),
        F.max("last_at").alias("last_listen"))
    return out.select(
        (F.col("heard") if n_all is None else n_all).alias("tracks_total"),
        (F.col("heard") if n_music is None else n_music).alias("music_tracks"),
        listens.agg(F.count(F.lit(1))).scalar().alias("listens_total"),
        "music_listens", "hours_est", "first_listen", "last_listen",
        features.agg(F.count(F.lit(1))).scalar().alias("analyzed"))


def period_numbers(listens, tracks, d_from=None, d_to=None) -> DataFrame:
    return base.music_counts(listens, tracks, d_from, d_to).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("listens"), _hours().alias("hours"),
        F.count_distinct("artist").alias("artists"), F.count(F.lit(1)).alias("tracks"))


def kpi(listens, tracks, d_from=None, d_to=None, as_of: dt.date | None = None) -> DataFrame:
    """Metric rows with value, value of the previous period and change in per cent.

    Both periods come from one scan: conditional counts per item, then one aggregate.
    """
    p_from, p_to = base.prev_bounds(d_from, d_to, as_of or d_to)
    cur = in_period("listened_at", d_from, d_to)
    prev = in_period("listened_at", p_from, p_to) if p_from else F.lit(False)
    per_track = (listens.filter(cur | prev).groupBy("track_id")
                 .agg(F.count_if(cur).alias("n_cur"), F.count_if(prev).alias("n_prev"))
                 .join(tracks.filter("is_music").select("track_id", "duration", artist().alias("artist")),
                       "track_id"))
    secs = base.seconds_or_default(F.col("duration"))

    def numbers(n: str) -> list[Column]:
        heard = F.col(n) > 0
        return [F.coalesce(F.sum(n), F.lit(0)).cast("double").alias("listens_" + n),
                rounded(F.coalesce(F.sum(F.col(n) * secs) / 3600, F.lit(0.0)), 1).alias("hours_" + n),
                F.count_distinct(F.when(heard, F.col("artist"))).cast("double").alias("artists_" + n),
                F.count_if(heard).cast("double").alias("tracks_" + n)]

    metrics = ["listens", "hours", "artists", "tracks"]
    wide = per_track.agg(*numbers("n_cur"), *numbers("n_prev"))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m + "_n_cur").alias("value"),
                              (F.col(m + "_n_prev") if p_from else F.lit(None).cast("double")).alias("prev"))
                     for m in metrics])
    return wide.select(F.inline(rows)).withColumn("delta", percent_change(F.col("value"), F.col("prev")))


def artists(listens, tracks, limit: int | None = None) -> DataFrame:
    """Plays, distinct items, last play and most played item of each canonical artist; all, or the `limit` most played."""
    out = (base.music_counts(listens, tracks).filter(F.col("artist") != "").groupBy("artist")
            .agg(F.sum("n").alias("plays"), F.count(F.lit(1)).alias("tracks"),
                 F.max("last_at").alias("last_listen"), top_item().alias("top_track_id"))
            .orderBy(F.col("plays").desc(), "artist"))
    return out if limit is None else out.limit(limit)


def top_item(value: Column | None = None, *ties: str) -> Column:
    """Most played item of a group as an aggregate, so no window over a hot artist is needed."""
    value = F.col("track_id") if value is None else value
    return F.min_by(value, F.struct(-F.col("n"), *[F.col(t) for t in ties], F.col("track_id")))


def artist_top_item(listens, tracks) -> DataFrame:
    return (base.music_counts(listens, tracks).filter(F.col("artist") != "").groupBy("artist")
            .agg(top_item().alias("top_track_id")))


def artist_summary(listens, tracks, d_from=None, d_to=None) -> DataFrame:
    """Header facts of every artist; one artist is a filter on it."""
    best = F.struct("track_id", "title", "channel", "n")
    return (base.music_counts(listens, tracks, d_from, d_to).groupBy("artist")
            .agg(F.sum("n").alias("plays"), F.count(F.lit(1)).alias("tracks"),
                 F.min("first_at").alias("first_listen"), F.max("last_at").alias("last_listen"),
                 top_item(best, "title").alias("top"))
            .select("artist", "plays", "tracks", "first_listen", "last_listen",
                    F.col("top.track_id").alias("top_track_id"), F.col("top.title").alias("top_title"),
                    F.col("top.channel").alias("top_channel"), F.col("top.n").alias("top_plays")))


def by_bucket(listens, tracks, name: str, expr: Column, d_from=None, d_to=None) -> DataFrame:
    return (base.music_counts(listens, tracks, d_from, d_to, **{name: expr})
            .groupBy(name).agg(F.sum("n").alias("listens")))


def by_hour(listens, tracks, d_from=None, d_to=None) -> DataFrame:
    return by_bucket(listens, tracks, "hour", hour_label("listened_at"), d_from, d_to).orderBy("hour")


def by_weekday(listens, tracks, d_from=None, d_to=None) -> DataFrame:
    names = F.array(*[F.lit(d) for d in C.WEEKDAYS])
    return (by_bucket(listens, tracks, "day", F.weekday("listened_at"), d_from, d_to)
            .orderBy("day").select(names[F.col("day")].alias("weekday"), "listens"))


def by_month(listens, tracks, d_from=None, d_to=None) -> DataFrame:
    return timeline(listens, tracks, "month", d_from, d_to).withColumnRenamed("bucket", "month")


def by_week(listens, tracks, d_from=None, d_to=None) -> DataFrame:
    return timeline(listens, tracks, "week", d_from, d_to).withColumnRenamed("bucket", "week")


def timeline(listens, tracks, granularity="month", d_from=None, d_to=None) -> DataFrame:
    return by_bucket(listens, tracks, "bucket", bucket("listened_at", granularity), d_from, d_to).orderBy("bucket")


def genre_distribution(listens, tracks, features, d_from=None, d_to=None, limit: int = 10) -> DataFrame:
    """Best genres weighted by plays, each row with the coverage of the whole period.

    All plays, the plays of tagged items and the plays of each genre are sums of one grouping: every table is read once.
    """
    counts = base.music_counts(listens, tracks, d_from, d_to).join(features.select("track_id", "tags", "genres"), "track_id", "left")
    tagged = F.coalesce(F.col("tags") != "", F.lit(False))
    cell = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"))       # noqa: E731
    none = F.array().cast("array<struct<kind:int,name:string>>")
    own = F.transform(F.filter("genres", lambda g: g["name"] != ""), lambda g: cell(2, g["name"]))
    cells = F.concat(F.array(cell(0, F.lit(None))), F.when(tagged, F.concat(F.array(cell(1, F.lit(None))), F.coalesce(own, none))).otherwise(none))
    sums = counts.select("n", F.explode(cells).alias("c")).groupBy("c.kind", "c.name").agg(F.sum("n").alias("listens"))
    every = Window.partitionBy()                                  # over the genres, not over plays
    plays = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("listens"))).over(every), F.lit(0))      # noqa: E731
    return (sums.withColumn("coverage", ratio(plays(1), plays(0))).filter(F.col("kind") == 2).select("name", "listens", "coverage")
            .orderBy(F.col("listens").desc(), "name").limit(limit))


def _weighted_mean(c: str, digits: int) -> Column:
    """Decimal sums are exact, so the last digit does not depend on the order of partial sums."""
    weight = F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
    total = F.sum(F.col(c).cast("decimal(18,9)") * F.col("n").cast("decimal(12,0)"))
    return rounded(total.cast("double") / weight, digits)


def avg_features(listens, tracks, features, d_from=None, d_to=None) -> DataFrame:
    counts = base.feature_counts(listens, tracks, features, d_from, d_to)
    digits = {"tempo": 1, "energy": 2, "danceability": 2, "acousticness": 2, "brightness": 2}
    out = counts.agg(*[_weighted_mean(c, d).alias(c) for c, d in digits.items()],
                     F.coalesce(F.sum("n"), F.lit(0)).alias("covered"))
    return out.select(*digits, ratio(F.col("covered"), _total_plays(listens, tracks, d_from, d_to))
                      .alias("coverage"))


def mood_profile(listens, tracks, features, d_from=None, d_to=None) -> DataFrame:
    counts = base.feature_counts(listens, tracks, features, d_from, d_to)
    return counts.agg(*[F.coalesce(_weighted_mean(c, 3), F.lit(0.0)).alias(c[5:]) for c in C.MOOD_COLS])


def by_key(listens, tracks, features, d_from=None, d_to=None, limit: int = 12) -> DataFrame:
    return (base.feature_counts(listens, tracks, features, d_from, d_to).filter(F.col("key") != "")
            .groupBy("key").agg(F.sum("n").alias("listens"))
            .orderBy(F.col("listens").desc(), "key").limit(limit))


def vocal_split(listens, tracks, features, d_from=None, d_to=None, fallback=C.VOCAL_RATIO_SPLIT) -> DataFrame:
    """Plays with and without voice; undecided counts as instrumental."""
    counts = base.feature_counts(listens, tracks, features, d_from, d_to)
    vocal = F.coalesce("has_vocals", F.col("vocal_ratio") >= fallback)
    out = counts.agg(F.coalesce(F.sum(F.when(vocal, F.col("n")).otherwise(0)), F.lit(0)).alias("vocal"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("covered"))
    return out.select("vocal", (F.col("covered") - F.col("vocal")).alias("instrumental"),
                      ratio(F.col("covered"), _total_plays(listens, tracks, d_from, d_to)).alias("coverage"))


def language_distribution(listens, tracks, lyrics, d_from=None, d_to=None, limit: int = 8) -> DataFrame:
    return (base.lyrics_counts(listens, tracks, lyrics, d_from, d_to).filter(F.col("language") != "")
            .groupBy("language").agg(F.sum("n").alias("listens"))
            .orderBy(F.col("listens").desc(), "language").limit(limit))


def mood_trend(listens, tracks, features, granularity="month", d_from=None, d_to=None) -> DataFrame:
    counts = base.feature_counts(listens, tracks, features, d_from, d_to,
                                 bucket=bucket("listened_at", granularity))
    return (counts.groupBy("bucket")
            .agg(*[_weighted_mean("mood_" + m, 3).alias(m) for m in ("happy", "sad", "relaxed", "party")],
                 F.sum("n").alias("listens")).orderBy("bucket"))


def first_in_period(listens, tracks, keys: list[str], d_from, d_to) -> DataFrame:
    """Groups whose first play ever lies in the period, with their plays inside it; an artist with the most played item ever.

    One pass: the count inside the period and the first play overall are aggregates of one group.
    """
    inside = in_period("listened_at", d_from, d_to)
    per_track = (listens.groupBy("track_id")
                 .agg(F.count_if(inside).alias("n"), F.count(F.lit(1)).alias("n_all"), F.min("listened_at").alias("first_at"))
                 .join(tracks.filter("is_music").select(
                     "track_id", "title", "channel", "duration", artist().alias("artist")), "track_id"))
    grouped = per_track if keys == ["track_id"] else per_track.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("first_at").alias("first_at"),
        F.min_by("track_id", F.struct(-F.col("n_all"), F.col("track_id"))).alias("top_track_id"))
    return grouped.filter(in_period("first_at", d_from, d_to) & (F.col("n") > 0))


def new_artists(listens, tracks, d_from=None, d_to=None, n: int = 5, as_of: dt.date | None = None) -> DataFrame:
    """Artists first heard in the period, with their most played item and the full count."""
    d_from, d_to = base.period_bounds(d_from, d_to, as_of)
    found = first_in_period(listens, tracks, ["artist"], d_from, d_to).filter(F.col("artist") != "")
    best = found.orderBy(F.col("n").desc(), "artist").limit(max(1, n))
    return best.select(F.col("artist").alias("name"), F.col("n").alias("plays"), "top_track_id",
                       found.agg(F.count(F.lit(1))).scalar().alias("total"))


def new_tracks(listens, tracks, features, d_from=None, d_to=None, n: int = 5, as_of=None) -> DataFrame:
    d_from, d_to = base.period_bounds(d_from, d_to, as_of)
    found = first_in_period(listens, tracks, ["track_id"], d_from, d_to)
    best = found.orderBy(F.col("n").desc(), "track_id").limit(max(1, n))
    return (best.join(features.select("track_id", "tempo", "energy"), "track_id", "left")
            .select("track_id", "title", "channel", "artist", F.col("n").alias("plays"), "duration",
                    rounded("tempo", 1).alias("tempo"), rounded("energy", 2).alias("energy"),
                    found.agg(F.count(F.lit(1))).scalar().alias("total")))


def coverage(listens, tracks, side: DataFrame, d_from=None, d_to=None) -> DataFrame:
    """Share of music plays whose item is present in `side`."""
    counts = base.music_counts(listens, tracks, d_from, d_to).join(
        side.select("track_id").distinct().withColumn("hit", F.lit(1)), "track_id", "left")
    return counts.agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("covered"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("listens")).withColumn(
        "coverage", ratio(F.col("covered"), F.col("listens")))


def share(df: DataFrame, c: str, name: str = "share") -> DataFrame:
    """Whole per cent of the column total; zero when the total is zero."""
    total = df.agg(F.sum(c)).scalar()
    return df.withColumn(name, F.when(total > 0, F.floor(F.col(c) / total * 100 + 0.5)).otherwise(0))
