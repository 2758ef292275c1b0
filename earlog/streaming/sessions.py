"""Sessions over a stream of plays."""
from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from earlog import config as C
from earlog.functions.ship import by_value

by_value(__name__)


def stream_sessions(plays: DataFrame, gap_min: int = C.SESSION_GAP_MIN, watermark: str = "1 day") -> DataFrame:
    """Closed sessions of each listener: first and last play, plays.

    `plays`: user_id, track_id, listened_at (timestamp). State per open session is three numbers,
    whatever its length. A play exactly `gap_min` minutes after the last one still belongs to the
    session, as in the batch operator; one microsecond is added because window ends are exclusive.
    """
    gap = f"{gap_min * 60} seconds 1 microsecond"
    return (plays.withWatermark("listened_at", watermark)
            .groupBy("user_id", F.session_window("listened_at", gap).alias("w"))
            .agg(F.min("listened_at").alias("session_start"), F.max("listened_at").alias("last_at"),
                 F.count(F.lit(1)).alias("listens")).drop("w"))


def _steps(plays: DataFrame) -> T.StructType:
    user, event, track = (plays.schema[c].dataType for c in ("user_id", "event_id", "track_id"))
    return T.StructType([T.StructField(n, t) for n, t in (
        ("kind", T.StringType()), ("user_id", user), ("session_start", T.TimestampType()), ("session_event", event),
        ("at", T.TimestampType()), ("cur", track), ("nxt", track), ("listens", T.LongType()))])


def _listener(gap_min: int, transition_gap_min: int, names: list[str]):
    """State of one listener: plays that older ones may still precede, and the open session."""
    gap, step = gap_min * 60_000_000, transition_gap_min * 60_000_000

    def advance(key, frames, state):
        waiting, session = pickle.loads(state.get[0]) if state.exists else ([], None)
        for pdf in frames:
            at = pdf["listened_at"].astype("datetime64[us]").astype("int64")
            waiting += zip(at.tolist(), pdf["event_id"].tolist(), pdf["track_id"].tolist())
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready = [w for w in waiting if w[0] <= mark]             # anything older would be dropped as late
        waiting = waiting[len(ready):]
        out = []

        def close():
            start, event, last, _, n = session
            out.append(("session", key[0], start, event, last, None, None, n))
        for at, event, track in ready:
            if session is not None and at - session[2] > gap:
                close()
                session = None
            if session is None:
                session = (at, event, at, track, 1)
                continue
            start, first, last, before, n = session
            if track != before and at - last <= step:
                out.append(("next", key[0], start, first, at, before, track, None))
            session = (start, first, at, track, n + 1)
        if session is not None and session[2] + gap <= mark and not (waiting and waiting[0][0] - session[2] <= gap):
            close()
            session = None
        if waiting or session is not None:
            state.update((pickle.dumps((waiting, session)),))
            due = min([w[0] for w in waiting[:1]] + ([session[2] + gap] if session else []))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            pdf = pd.DataFrame(out, columns=names, dtype=object)
            for c in ("session_start", "at"):
                pdf[c] = pd.to_datetime(pdf[c].astype("int64"), unit="us")
            yield pdf
    return advance


def stream_steps(plays: DataFrame, gap_min: int = C.SESSION_GAP_MIN, transition_gap_min: int = C.TRANSITION_GAP_MIN,
                 watermark: str = "1 day") -> DataFrame:
    """Sessions and next-item transitions of each listener, as the batch operators give them, from plays in any order.

    `plays`: user_id, event_id, track_id, listened_at (timestamp). A play waits until the watermark has passed it, so plays that
    arrive up to the watermark's delay late still find their place; those that come later are dropped. kind `next`: cur, nxt and
    the time of the step, sent as soon as it is certain; kind `session`: start, last play and plays, sent once it is over. State
    of a listener is the open session and the plays of the last stretch of the watermark's length.
    """
    rows = plays.select("user_id", "event_id", "track_id", "listened_at").withWatermark("listened_at", watermark)
    steps = _steps(plays)
    return rows.groupBy("user_id").applyInPandasWithState(
        _listener(gap_min, transition_gap_min, steps.fieldNames()), steps, "blob binary", "append", GroupStateTimeout.EventTimeTimeout)
