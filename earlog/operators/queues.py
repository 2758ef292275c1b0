"""Work queues and derived state: what is left to do, what failed, what can be filled in."""
from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from earlog import config as C
from earlog.functions.columns import artist, col, ntz
from earlog.functions.text import canonical_artist
from earlog.operators import base, catalog
from earlog.operators.scores import vocal_score

# --- fixed values: error texts ----------------------------------------------------------
DEAD_MARKERS = ("video unavailable", "this video is not available", "private video", "is private",
                "removed by the uploader", "has been removed", "available in your country",
                "has been terminated")
BOT_MARKERS = ("sign in to confirm", "not a bot")
NETWORK_MARKERS = ("ssl", "record_layer", "connection", "timed out", "timeout", "reset", "network",
                   "temporarily unavailable", "http error 403", "http 403", "http error 429",
                   "http 429", "too many requests")
# --- end of fixed values ----------------------------------------------------------------


def _any(text: Column, markers) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(text, F.lit(m))
    return hit


def error_class(error: Column | str) -> Column:
    low = F.lower(col(error))
    return F.when(_any(low, DEAD_MARKERS), "dead").when(_any(low, BOT_MARKERS), "bot").otherwise("other")


def is_network_error(error: Column | str) -> Column:
    return _any(F.lower(F.coalesce(col(error), F.lit(""))), NETWORK_MARKERS)


def error_classes(log: DataFrame) -> DataFrame:
    failed = log.filter(F.col("status") == "dl-error")
    return failed.groupBy(error_class("error").alias("kind"), is_network_error("error").alias("network")).agg(
        F.count(F.lit(1)).alias("n"))


def _runs(by: list[str]):
    """Per range of the log and key: what decides runs across its ends, and the runs that lie inside."""
    def run(batches):
        key, done = None, []

        def batch():
            names = ["part", *(f"k{i}" for i in range(len(by))), "ended", "head", "tail", "longest", "runs"]
            out = pa.RecordBatch.from_pylist([dict(zip(names, (p, *k, *v))) for p, k, v in done], pa.schema(
                [("part", pa.int32()), *((f"k{i}", types[i]) for i in range(len(by))), ("ended", pa.bool_()),
                 *((n, pa.int64()) for n in ("head", "tail", "longest", "runs"))]))
            done.clear()
            return out
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(c).type for c in by]
            keys = list(zip(*(b[c].to_pylist() for c in by))) if by else [()] * b.num_rows
            part, ok, hit = b["part"][0].as_py(), np.asarray(b["ok"]), np.asarray(b["hit"])
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if by else [0, len(keys)]
            for i, j in zip(edges, edges[1:]):
                if done and key == keys[i] and done[-1][1] == key:
                    state = done.pop()[2]
                else:
                    state = (False, 0, 0, 0, 0)
                key = keys[i]
                ended, head, tail, longest, runs = state
                # hits of each stretch; a success opens the next one
                sums = np.bincount(np.cumsum(ok[i:j]), weights=hit[i:j], minlength=int(ok[i:j].sum()) + 1).astype(int)
                if len(sums) == 1:
                    head, tail = (head, tail + int(sums[0])) if ended else (head + int(sums[0]), 0)
                else:
                    inner = sums[1:-1] if not ended else np.concatenate([[tail + sums[0]], sums[1:-1]])
                    head = head if ended else head + int(sums[0])
                    longest, runs = max(longest, int(inner.max(initial=0))), runs + int((inner > 0).sum())
                    ended, tail = True, int(sums[-1])
                done.append((part, key, (ended, head, tail, longest, runs)))
            if len(done) > 1:
                last = done.pop()
                yield batch()
                done.append(last)
        if done:
            yield batch()
    return run


def failure_streaks(log: DataFrame, kind: str = "bot", limit: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Longest run of failures of a kind between two successes, and whether it reaches the limit.

    Only a success ends a run. The log is laid out by ranges of (key, time), each task folds its range to one summary a key
    (failures before the first and after the last success, longest run and runs between them), and summaries are folded in
    order: at most one for each range meets in a row, however the events lie in time.
    """
    by = by or []
    limit = limit or (C.BOT_STREAK if kind == "bot" else C.NETWORK_STREAK)
    failed = F.col("status") == "dl-error"
    hit = failed & (is_network_error("error") if kind == "network" else error_class("error") == kind)
    order = [*by, "tried_at", "event_id"]
    rows = log.select(*order, F.coalesce(F.col("status") == "ok", F.lit(False)).alias("ok"), F.coalesce(hit, F.lit(False)).alias("hit"))
    rows = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(f"k{i}", log.schema[c].dataType) for i, c in enumerate(by)),
                           T.StructField("ended", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("head", "tail", "longest", "runs"))])
    parts = rows.mapInArrow(_runs(by), schema)
    listed = parts.groupBy(*(f"k{i}" for i in range(len(by)))).agg(F.sort_array(F.collect_list(F.struct(
        "part", "ended", "head", "tail", "longest", "runs"))).alias("xs"))

    def state(now, longest, runs):
        return F.struct(now.alias("now"), longest.alias("longest"), runs.alias("runs"))

    def closed(s, extra):
        n = s["now"] + extra
        return F.greatest(s["longest"], n), s["runs"] + F.when(n > 0, 1).otherwise(0)

    def step(s, x):
        longest, runs = closed(s, x["head"])
        ended = state(x["tail"], F.greatest(longest, x["longest"]), runs + x["runs"])
        return F.when(x["ended"], ended).otherwise(state(s["now"] + x["head"], s["longest"], s["runs"]))
    zero = F.lit(0).cast("bigint")
    out = listed.withColumn("e", F.aggregate("xs", state(zero, zero, zero), step, lambda s: F.struct(
        closed(s, zero)[0].alias("longest"), closed(s, zero)[1].cast("bigint").alias("runs"))))
    return out.where(F.size("xs") > 0).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(by)), "e.longest", "e.runs",
                                             (F.col("e.longest") >= limit).alias("reached"))


def current_errors(log: DataFrame, longest: int | None = C.ERROR_TEXT_MAX) -> DataFrame:
    """Latest outcome per (item, stage), kept while it is a failure; skips change nothing. `longest` None: whole error texts."""
    outcome = F.struct("status", "error", "tried_at")
    last = (log.filter(F.col("status") != "skipped").groupBy("track_id", "stage")
            .agg(F.max_by(outcome, F.struct("tried_at", "event_id")).alias("o")))
    text = F.coalesce(F.nullif(F.col("o.error"), F.lit("")), F.lit("unknown error"))
    shown = text if longest is None else F.left(text, F.lit(longest))
    return last.filter(F.col("o.status") != "ok").select(
        "track_id", "stage", shown.alias("error"), F.col("o.tried_at").alias("created_at"))


def list_errors(errors: DataFrame, tracks: DataFrame, n: int = 200) -> DataFrame:
    """Newest current errors with the item's names."""
    names = tracks.select("track_id", "title", "channel", artist().alias("artist"))
    return errors.join(names, "track_id").orderBy(F.col("created_at").desc(), "track_id", "stage").limit(n)


def unavailable(marks: DataFrame, as_of: dt.date, ttl_days: int = C.UNAVAILABLE_TTL_DAYS) -> DataFrame:
    """Items whose mark (a date text) is still valid."""
    stamp = F.try_to_date("stamp", "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.col("stamp").try_cast("date")
    return marks.filter(stamp > F.lit(as_of - dt.timedelta(days=ttl_days))).select("track_id")


def is_fresh(fetched_at: Column | str, hit: Column, as_of: dt.datetime, ttl_days: int, miss_ttl_days: int) -> Column:
    """Cached row young enough; misses expire sooner."""
    at = col(fetched_at)
    return F.when(hit, at >= ntz(as_of - dt.timedelta(days=ttl_days))).otherwise(
        at >= ntz(as_of - dt.timedelta(days=miss_ttl_days)))


def analysis(tracks, features, marks, as_of: dt.date, n: int = 0, version: int = C.FEATURE_VERSION,
             min_plays: int = C.MIN_PLAY_COUNT) -> DataFrame:
    """Music items to analyse, most played first; cut to n, then minus the unavailable ones."""
    done = features.filter((F.col("source") == "audio") & (F.col("feat_version") >= version))
    todo = base.anti(tracks.filter(F.col("is_music") & (F.col("play_count") >= min_plays)), done.select("track_id"))
    todo = todo.select("track_id", "title", "play_count")
    if n > 0:
        todo = todo.orderBy(F.col("play_count").desc(), "track_id").limit(n)
    return base.anti(todo, unavailable(marks, as_of)).orderBy(F.col("play_count").desc(), "track_id")


def texts(tracks, features, lyrics, n: int = 0, min_plays: int = C.MIN_PLAY_COUNT) -> DataFrame:
    """Analysed music items without a text row, by plays, then vocal score."""
    todo = tracks.filter(F.col("is_music") & (F.col("play_count") >= min_plays)).select("track_id", "title", "play_count")
    todo = base.anti(todo.join(features.select("track_id", vocal_score().alias("score")), "track_id"), lyrics.select("track_id"))
    todo = todo.orderBy(F.col("play_count").desc(), F.col("score").desc(), "track_id")
    return todo.limit(n) if n > 0 else todo


def artists(tracks, cache, as_of: dt.datetime, n: int = 0) -> DataFrame:
    """Artists by plays without a fresh cache row (name, mbid, fetched_at)."""
    fresh = cache.filter(is_fresh("fetched_at", F.coalesce("mbid", F.lit("")) != "", as_of,
                                  C.ARTIST_CACHE_DAYS, C.ARTIST_CACHE_MISS_DAYS))
    todo = base.anti(catalog.artist_play_totals(tracks), fresh.select(F.col("name").alias("artist")), "artist")
    todo = todo.orderBy(F.col("plays").desc(), "artist")
    return todo.limit(n) if n > 0 else todo


# ---- backfills ------------------------------------------------------------------------------
def backfill_vocals(features, lyrics) -> DataFrame:
    """An item with a text has words: undecided verdicts become true."""
    has = lyrics.filter(F.col("text") != "").select("track_id", F.lit(True).alias("_t"))
    return features.join(has, "track_id", "left").withColumn("has_vocals", F.coalesce("has_vocals", "_t")).drop("_t")


def backfill_artist(tracks) -> DataFrame:
    return tracks.withColumn("artist_canonical", F.coalesce(
        F.nullif("artist_canonical", F.lit("")), canonical_artist("channel")))


def backfill_topics(lyrics, derived: Column) -> DataFrame:
    """Topics only where none are stored."""
    return lyrics.withColumn("topics", F.when(F.col("topics").isNull() | (F.size("topics") == 0), derived)
                             .otherwise(F.col("topics")))


def backfill_duration(tracks, measured) -> DataFrame:
    """Missing or zero duration from the measured one (track_id, measured)."""
    return tracks.join(measured.select("track_id", F.col("measured").alias("_m")), "track_id", "left").withColumn(
        "duration", F.coalesce(F.nullif("duration", F.lit(0.0)), "_m", "duration")).drop("_m")
