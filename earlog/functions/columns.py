"""Column expressions shared by the operators. All stay inside JVM codegen."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from earlog import config as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def artist(canonical: Column | str = "artist_canonical", channel: Column | str = "channel") -> Column:
    """Canonical artist, or the channel where the canonical name is empty."""
    return F.coalesce(F.nullif(col(canonical), F.lit("")), col(channel))


def in_period(ts: Column | str, d_from: dt.date | None = None, d_to: dt.date | None = None) -> Column:
    """Half-open period [from 00:00, to + 1 day 00:00); an absent bound is open."""
    ts = col(ts)
    cond = F.lit(True)
    if d_from is not None:
        cond = cond & (ts >= ntz(d_from))
    if d_to is not None:
        cond = cond & (ts < ntz(d_to + dt.timedelta(days=1)))
    return cond


def ntz(value: dt.date | dt.datetime) -> Column:
    """Timestamp without zone as a literal, so period filters reach the Parquet scan."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time.min)
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def bucket(ts: Column | str, granularity: str = "month") -> Column:
    """Monday date for weeks, YYYY-MM for months; independent of the session zone."""
    ts = col(ts)
    if granularity == "week":
        day = F.to_date(ts)
        return F.date_sub(day, F.weekday(day)).cast("string")
    if granularity == "month":
        return F.date_format(ts, "yyyy-MM")
    raise ValueError(f"granularity must be month or week, not {granularity!r}")


def hour_label(ts: Column | str) -> Column:
    return F.lpad(F.hour(col(ts)).cast("string"), 2, "0")


def whole_days(later: Column, earlier: Column) -> Column:
    """Completed 24-hour days from `earlier` to `later`."""
    return F.extract(F.lit("DAY"), later - earlier)


def decay(last_at: Column | str, as_of: Column, half_life_days: int = C.HALF_LIFE_DAYS) -> Column:
    """Weight that halves every `half_life_days` whole days; unknown time gives one half."""
    days = F.greatest(whole_days(as_of, col(last_at)), F.lit(0))
    return F.when(col(last_at).isNull(), 0.5).otherwise(F.pow(F.lit(0.5), days / F.lit(float(half_life_days))))


def repeat_penalty(last_at: Column | str, as_of: Column) -> Column:
    age = as_of - col(last_at)
    return (F.when(age < F.expr("INTERVAL '24' HOUR"), 0.25)
            .when(age < F.expr("INTERVAL '72' HOUR"), 0.6).otherwise(1.0))


def rounded(c: Column | str, digits: int) -> Column:
    """Round half to even, the way Python's round does; built-in `round` takes halves away from zero."""
    scale = 10.0 ** digits
    return F.rint(col(c) * scale) / scale


def let(value: Column, body) -> Column:
    """Bind an expensive expression to a name: it is evaluated once however often `body` uses it.

    Inside lambdas the optimizer does not share common subexpressions.
    """
    return F.transform(F.array(value), body)[0]


def ratio(part: Column, total: Column, digits: int = 3) -> Column:
    """Rounded share, zero when there is nothing to divide by."""
    return rounded(F.when(total > 0, part / total).otherwise(0.0), digits)


def half_up(x: Column) -> Column:
    """Round half towards plus infinity, the way browser code does."""
    return F.floor(x + 0.5)


def percent_change(value: Column, prev: Column) -> Column:
    """Whole per cent; NULL when the base is missing, zero or unchanged."""
    return F.when(prev.isNotNull() & (prev != 0) & (value != prev),
                  half_up((value - prev) / prev * 100)).cast("bigint")


def lookup(table: dict, key: Column) -> Column:
    """Small constant table as a map literal; NULL when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)
