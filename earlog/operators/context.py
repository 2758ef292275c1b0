"""What fits the moment, and external similarity lists joined with the own history."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from earlog import config as C
from earlog.functions.columns import artist, col, in_period, ntz, repeat_penalty, rounded
from earlog.operators import base

# --- fixed values: wording and limits of the reason text --------------------------------
DAY_NAMES = ["Mondays", "Tuesdays", "Wednesdays", "Thursdays", "Fridays", "Saturdays", "Sundays"]
REASON_SHARE, REASON_MIN = 0.25, 2
DEFAULT_REASON = "fits this time of day"
# --- end of fixed values ----------------------------------------------------------------


def reason(hour: int, weekday: int, at_hour: Column, at_weekday: Column, total: Column) -> Column:
    def often(n: Column) -> Column:
        return (n >= REASON_MIN) & (n / total >= REASON_SHARE)
    text = F.concat_ws(", ", F.when(often(at_hour), f"often at {hour:02d}:00"),
                       F.when(often(at_weekday), f"on {DAY_NAMES[weekday]}"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(DEFAULT_REASON))


def context_scores(listens, tracks, hour: int, weekday: int, as_of: dt.datetime, d_from=None, d_to=None) -> DataFrame:
    """Per music item: plays at the hour and the weekday, total, last play, unrounded score."""
    counts = (listens.filter(in_period("listened_at", d_from, d_to)).groupBy("track_id")
              .agg(F.count_if(F.hour("listened_at") == hour).alias("at_hour"),
                   F.count_if(F.weekday("listened_at") == weekday).alias("at_weekday"),
                   F.count(F.lit(1)).alias("plays"), F.max("listened_at").alias("last_at")))
    rows = base.semi(counts, tracks.filter("is_music"))
    p_hour = (F.col("at_hour") + 1) / (F.col("plays") + 24)
    p_day = (F.col("at_weekday") + 1) / (F.col("plays") + 7)
    return rows.withColumn("raw_score", (p_hour * 0.6 + p_day * 0.4) * F.sqrt(F.col("plays") + 1)
                           * repeat_penalty("last_at", ntz(as_of)))


def for_now(listens, tracks, hour: int, weekday: int, as_of: dt.datetime, n: int = 12, d_from=None, d_to=None) -> DataFrame:
    """Best items for an hour (0..23) and weekday (0 = Monday)."""
    scored = context_scores(listens, tracks, hour, weekday, as_of, d_from, d_to)
    total = scored.agg(F.count(F.lit(1))).scalar()
    best = base.top_k(scored, "raw_score", "track_id", n)
    return best.join(tracks.select("track_id", "title", "channel", artist().alias("artist")), "track_id").select(
        "track_id", "title", "channel", "artist", "plays", "at_hour", "at_weekday",
        rounded("raw_score", 3).alias("score"),
        reason(hour, weekday, F.col("at_hour"), F.col("at_weekday"), F.col("plays")).alias("reason"),
        total.alias("total"))


# ---- external lists -----------------------------------------------------------------------
def length_seconds(text: Column | str) -> Column:
    """'3:07', '1:03:07' or plain seconds to seconds; NULL for anything else."""
    parts = F.split(F.trim(col(text).cast("string")), ":")
    ok = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.rlike("^[0-9]+$"))
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 60 + p.try_cast("bigint"))
    return F.when(ok, value.cast("double"))


def flatten_external(external: DataFrame) -> DataFrame:
    """One row per listed item: empty ids dropped, the first of duplicates kept.

    Input: seed_id and items array<struct<videoId,title,artists,album,year,length,thumbnail>>.
    The first occurrence is found inside the row, as the list is one value.
    """
    named = F.filter("items", lambda x: F.coalesce(x["videoId"], F.lit("")) != "")
    ids = F.transform(named, lambda x: x["videoId"])
    first = F.filter(named, lambda x, i: F.array_position(ids, x["videoId"]) == i + 1)
    x = F.col("x")
    widest = F.array_max(F.transform(x["thumbnail"], lambda t, i: F.struct(
        F.coalesce(t["width"], F.lit(0)), -i, F.coalesce(t["url"], F.lit("")).alias("url"))))
    names = F.filter(F.transform(x["artists"], lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return external.select("seed_id", F.posexplode(first).alias("pos", "x")).select(
        "seed_id", "pos", x["videoId"].alias("track_id"), F.coalesce(x["title"], F.lit("")).alias("title"),
        F.coalesce(F.array_join(names, ", "), F.lit("")).alias("artist"),
        F.coalesce(x["album"]["name"], F.lit("")).alias("album"),
        F.coalesce(x["year"].cast("string"), F.lit("")).alias("year"),
        F.coalesce(widest["url"], F.lit("")).alias("thumbnail"), length_seconds(x["length"]).alias("duration"))


def split_seed(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Marks the entry that is the seed itself: by id, else by the folded title of the seed.

    `titles`: seed_id, seed_title and, where seed_id names a list and not the item itself, seed_track.
    """
    folded = lambda c: F.trim(F.lower(c))                                          # noqa: E731
    own = "seed_track" in titles.columns
    by_id = F.col("track_id") == F.col("seed_track" if own else "seed_id")
    by_title = (folded(F.col("seed_title")) != "") & (folded(F.col("title")) == folded(F.col("seed_title")))
    w = Window.partitionBy("seed_id").orderBy(F.when(by_id, 0).when(F.coalesce(by_title, F.lit(False)), 1).otherwise(2), "pos")
    out = rows.join(titles, "seed_id", "left").withColumn("_rn", F.row_number().over(w))
    hit = (F.col("_rn") == 1) & (by_id | F.coalesce(by_title, F.lit(False)))
    return out.withColumn("is_seed", hit).drop("_rn", "seed_title", "seed_track")


def seed_meta(rows: DataFrame) -> DataFrame:
    """Album facts of the seeds found in their own list."""
    return rows.filter("is_seed").select("seed_id", "album", "year", "artist", "thumbnail")


def enrich_external_similar(external, titles, tracks, listens, matches: DataFrame | None = None) -> DataFrame:
    """External lists without the seed, joined with the catalogue, the play range and the tag match.

    `matches`: seed_id, track_id, similarity 0..1 (see `similarity.pair_match`).
    """
    rows = split_seed(flatten_external(external), titles).filter(~F.col("is_seed"))
    known = tracks.select("track_id", "play_count", F.lit(True).alias("in_history"))
    ranges = base.play_counts(listens).select("track_id", F.date_format("first_at", "yyyy-MM-dd").alias("first_listen"),
                                              F.date_format("last_at", "yyyy-MM-dd").alias("last_listen"))
    own = known.join(ranges, "track_id", "left")
    out = rows.join(own, "track_id", "left").withColumn("in_history", F.coalesce("in_history", F.lit(False)))
    if matches is not None:
        out = out.join(matches.select("seed_id", "track_id", rounded(F.col("similarity") * 100, 0).cast("int").alias("match")),
                       ["seed_id", "track_id"], "left")
    return out.drop("is_seed")


def enrich_similar_artists(external: DataFrame, totals: DataFrame, keep: int = 25, n: int = 12) -> DataFrame:
    """Listed artists of each reference id with own plays.

    Input: mbid and items array<struct<reference_mbid,artist_mbid,name,comment,type,score>>;
    `totals`: artist, plays. The first `keep` usable entries are what a cache holds, `n` are shown.
    """
    from earlog.functions.text import canonical_artist
    usable = F.filter("items", lambda x: (x["reference_mbid"] == F.col("mbid")) & (F.coalesce(x["name"], F.lit("")) != ""))
    x = F.col("x")
    rows = external.select("mbid", F.posexplode(F.slice(F.slice(usable, 1, keep), 1, n)).alias("pos", "x")).select(
        "mbid", "pos", x["name"].alias("name"), F.coalesce(x["artist_mbid"], F.lit("")).alias("artist_mbid"),
        F.coalesce(x["comment"], F.lit("")).alias("comment"), F.coalesce(x["type"], F.lit("")).alias("type"),
        F.coalesce(x["score"].cast("int"), F.lit(0)).alias("score"))
    return enrich_own(rows.withColumn("artist", canonical_artist("name")), totals).drop("artist")


def enrich_own(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Own plays of an artist and whether it is in the history at all."""
    own = totals.select("artist", F.col("plays").alias("_p"))
    return rows.join(own, "artist", "left").withColumns({
        "plays": F.coalesce("_p", F.lit(0)).cast("bigint"), "in_history": F.col("_p").isNotNull()}).drop("_p")
