"""Listening sessions, co-occurrence pairs and next-item transitions.

Sessions are cut per listener. A listener with a third of all plays would make one window
partition of that size, so rows are windowed per (listener, hour) and only one summary row per
listener and hour is chained over time. The result equals one ordered pass per listener.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from earlog import config as C
from earlog.functions.columns import decay, ntz, rounded
from earlog.operators import base
from earlog.session import ensure_checkpoint_dir

SESSION = ["user_id", "session_start", "session_event"]


def _minutes(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' MINUTE")


def sessionize(listens: DataFrame, gap_min: int = C.SESSION_GAP_MIN) -> DataFrame:
    """Adds the session (its first play and the time of its last one) and the previous play inside the session.

    Input: user_id, event_id, track_id, listened_at. A gap strictly above `gap_min` minutes starts
    a session; equal times are ordered by event_id.
    """
    hour = F.unix_date(F.to_date("listened_at")) * 24 + F.hour("listened_at")
    rows = listens.select("user_id", "event_id", "track_id", "listened_at", hour.alias("_h"))
    key = ["user_id", "_h"]
    in_hour = Window.partitionBy(*key).orderBy("listened_at", "event_id")
    this = F.struct("listened_at", "event_id", "track_id")
    rows = rows.withColumn("_prev", F.lag(this).over(in_hour))
    cut = F.col("listened_at") - F.col("_prev.listened_at") > _minutes(gap_min)
    rows = rows.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    start = F.when(F.col("_cut"), F.struct("listened_at", "event_id"))
    rows = rows.withColumn("_start", F.last(start, ignorenulls=True).over(
        in_hour.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    closes = F.when(F.lead("_cut").over(in_hour), F.col("listened_at"))
    rows = rows.withColumn("_closes", closes).withColumn("_end", F.first("_closes", ignorenulls=True).over(
        in_hour.rowsBetween(Window.currentRow, Window.unboundedFollowing)))

    # one row per listener and hour: how the hour begins, ends, and where its last session began
    over_time = Window.partitionBy("user_id").orderBy("_h")
    hours = rows.groupBy(*key).agg(F.min(this).alias("_first"), F.max(this).alias("_last"),
                                   F.max("_start").alias("_inner"), F.min("_closes").alias("_cut_at"))
    hours = hours.withColumn("_before", F.lag("_last").over(over_time))
    opens = F.col("_before").isNull() | (
        F.col("_first.listened_at") - F.col("_before.listened_at") > _minutes(gap_min))
    head = F.when(opens, F.struct("_first.listened_at", "_first.event_id"))
    hours = hours.withColumn("_own", head)
    hours = hours.withColumn("_head", F.coalesce("_own", F.last(F.coalesce("_inner", "_own"), ignorenulls=True).over(
        over_time.rowsBetween(Window.unboundedPreceding, -1))))
    # the hour's last session ends here when the next hour opens one, or where the next hour cuts it
    following = lambda c: F.lead(c).over(over_time)                                 # noqa: E731
    ends = F.when(following("_h").isNull() | following("_own").isNotNull(), F.col("_last.listened_at")).otherwise(following("_cut_at"))
    hours = hours.withColumn("_ends", ends).withColumn("_tail", F.first("_ends", ignorenulls=True).over(
        over_time.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    hours = hours.select(*key, "_head", "_tail", F.when(F.col("_own").isNull(), F.col("_before")).alias("_before"))

    out = rows.join(hours, key)
    session = F.coalesce("_start", "_head")
    prev = F.when(~F.col("_cut"), F.coalesce("_prev", "_before"))
    return out.select("user_id", "event_id", "track_id", "listened_at",
                      session["listened_at"].alias("session_start"), session["event_id"].alias("session_event"),
                      F.coalesce("_end", "_tail").alias("session_end"),
                      prev["track_id"].alias("prev_track"), prev["listened_at"].alias("prev_at"))


def with_last_at(sessions: DataFrame) -> DataFrame:
    """Session facts: last play, plays and distinct items."""
    per_item = sessions.groupBy(*SESSION, "track_id").agg(F.max("session_end").alias("m"),
                                                          F.count(F.lit(1)).alias("n"))
    return per_item.groupBy(*SESSION).agg(F.max("m").alias("last_at"), F.sum("n").alias("listens"),
                                          F.count(F.lit(1)).alias("tracks"))


def guarded(sessions: DataFrame, max_tracks: int = C.SESSION_MAX_TRACKS) -> DataFrame:
    """Sessions small enough for pairs, each with its sorted distinct items.

    One row more than the limit is kept per session and then told apart by size, so an endless
    session is cut to `max_tracks + 1` items per map task before it is shuffled.
    """
    items = sessions.groupBy(*SESSION, "track_id").agg(F.max("session_end").alias("at"))
    few = base.first_k(items, SESSION, [F.col("track_id")], max_tracks + 1)
    return (few.groupBy(*SESSION).agg(F.sort_array(F.collect_list("track_id")).alias("ids"),
                                      F.max("at").alias("last_at"))
            .filter(F.size("ids") <= max_tracks))


def pairs(sessions: DataFrame, max_tracks: int = C.SESSION_MAX_TRACKS) -> DataFrame:
    """Unordered item pairs of each session, at most max_tracks·(max_tracks−1)/2 per session."""
    small = guarded(sessions, max_tracks)
    first = small.select("ids", "last_at", F.posexplode("ids").alias("i", "track_a"))
    return first.select("track_a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("track_b"), "last_at")


def build_cooccur(listens, tracks=None, gap_min=C.SESSION_GAP_MIN, max_tracks=C.SESSION_MAX_TRACKS,
                  sessions: DataFrame | None = None) -> DataFrame:
    """Per unordered pair: shared sessions and the end of the latest one."""
    s = sessions if sessions is not None else _music_sessions(listens, tracks, gap_min)
    return pairs(s, max_tracks).groupBy("track_a", "track_b").agg(
        F.count(F.lit(1)).alias("cnt"), F.max("last_at").alias("last_at"))


def transitions(sessions: DataFrame, gap_min: int = C.TRANSITION_GAP_MIN) -> DataFrame:
    """Consecutive plays of different items with a gap of at most `gap_min` minutes."""
    step = F.col("listened_at") - F.col("prev_at") <= _minutes(gap_min)
    return sessions.filter(step & (F.col("prev_track") != F.col("track_id"))).select(
        *SESSION, "session_end", F.col("prev_track").alias("cur"), F.col("track_id").alias("nxt"))


def build_next(listens, tracks=None, gap_min=C.SESSION_GAP_MIN, markov_gap_min=C.TRANSITION_GAP_MIN,
               sessions: DataFrame | None = None) -> DataFrame:
    """Per directed pair: transitions and the end of the latest session, in one grouping."""
    s = sessions if sessions is not None else _music_sessions(listens, tracks, gap_min)
    return transitions(s, markov_gap_min).groupBy("cur", "nxt").agg(
        F.count(F.lit(1)).alias("cnt"), F.max("session_end").alias("last_at"))


def _music_sessions(listens, tracks, gap_min) -> DataFrame:
    rows = base.music_listens(listens, tracks) if tracks is not None else listens
    return sessionize(rows, gap_min)


def session_stats(listens, tracks=None, gap_min=C.SESSION_GAP_MIN, markov_gap_min=C.TRANSITION_GAP_MIN,
                  max_tracks=C.SESSION_MAX_TRACKS) -> DataFrame:
    """Numbers of a build: sessions, distinct pairs, distinct transitions, oversized sessions."""
    ensure_checkpoint_dir(listens.sparkSession)
    s = _music_sessions(listens, tracks, gap_min).checkpoint()       # three numbers read them
    facts = with_last_at(s).agg(F.count(F.lit(1)).alias("sessions"),
                                F.count_if(F.col("tracks") > max_tracks).alias("oversized"))
    n_pairs = build_cooccur(None, sessions=s, max_tracks=max_tracks).agg(F.count(F.lit(1))).scalar()
    n_steps = transitions(s, markov_gap_min).select("cur", "nxt").distinct().agg(F.count(F.lit(1))).scalar()
    return facts.select("sessions", n_pairs.alias("pairs"), n_steps.alias("transitions"), "oversized")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each unordered pair seen from both sides."""
    sides = F.array(F.struct(F.col("track_a").alias("seed"), F.col("track_b").alias("other")),
                    F.struct(F.col("track_b").alias("seed"), F.col("track_a").alias("other")))
    return edges.select(F.inline(sides), "cnt", "last_at")


def co_listened(cooccur: DataFrame, as_of: dt.datetime, n: int = 10, tracks: DataFrame | None = None) -> DataFrame:
    """Best partners of every seed by recency-weighted count, with the number of partners."""
    edges = symmetric(cooccur).withColumn("score", F.col("cnt") * decay("last_at", ntz(as_of)))
    return _ranked(edges, "seed", "other", n, tracks)


def next_tracks(edges: DataFrame, as_of: dt.datetime, n: int = 10, tracks: DataFrame | None = None) -> DataFrame:
    """Best successors of every item: smoothed probability times recency weight. `edges` is read twice: store it first."""
    sums = edges.groupBy("cur").agg((F.sum("cnt") + F.count(F.lit(1))).alias("mass"), F.count(F.lit(1)).alias("total"))
    rows = (edges.join(sums, "cur").withColumn("p", (F.col("cnt") + 1) / F.col("mass"))
            .withColumn("score", F.col("p") * decay("last_at", ntz(as_of)))
            .select(F.col("cur").alias("seed"), F.col("nxt").alias("other"), "cnt", "last_at", "p", "score", "total"))
    return _ranked(rows, "seed", "other", n, tracks)


def _ranked(rows: DataFrame, seed: str, other: str, n: int, tracks: DataFrame | None) -> DataFrame:
    """Top n per seed. The total is a separate partial aggregate, so the rank filter can be pushed
    below the shuffle and a hot seed never lands whole in one task."""
    best = base.first_k(rows, [seed], [F.col("score").desc(), F.col(other)], n, rank="rank")
    if "total" not in rows.columns:
        best = best.join(rows.groupBy(seed).agg(F.count(F.lit(1)).alias("total")), seed)
    if tracks is not None:
        best = best.join(tracks.select(F.col("track_id").alias(other), "title", "channel"), other)
    p = [rounded("p", 3).alias("p")] if "p" in best.columns else []
    extra = ["title", "channel"] if tracks is not None else []
    return best.select(seed, "rank", other, *extra, "cnt", "last_at", *p, rounded("score", 3).alias("score"), "total")
