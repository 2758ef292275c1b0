"""Statistics queries over the dated history (days and months) and the event log (hours)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from earlog import config as C
from earlog.operators import base, stats
from earlog.plans import inputs as I
from earlog.plans.registry import query

FROM, TO = dt.date(1998, 3, 1), dt.date(1998, 8, 31)
NOW = dt.date(2001, 12, 1)
_IN = "listened_at >= TIMESTAMP '1998-03-01' AND listened_at < TIMESTAMP '1998-09-01'"
_PREV = "listened_at >= TIMESTAMP '1997-08-29' AND listened_at < TIMESTAMP '1998-03-01'"
_MUSIC = "FROM plays l JOIN tracks t USING (track_id) WHERE t.is_music"
_FEAT = "FROM plays l JOIN tracks t USING (track_id) JOIN features f USING (track_id) WHERE t.is_music"
_HOURS = "round_even(COALESCE(sum(COALESCE(duration, 210)), 0) / 3600, 1)"


def _pt(spark, sf):
    return I.plays(spark, sf), I.tracks(spark, sf)


@query("totals", f"""SELECT (SELECT count(*) FROM tracks) AS tracks_total,
    (SELECT count(*) FROM tracks WHERE is_music) AS music_tracks, (SELECT count(*) FROM plays) AS listens_total,
    count(*) AS music_listens, {_HOURS} AS hours_est, min(listened_at) AS first_listen,
    max(listened_at) AS last_listen, (SELECT count(*) FROM features) AS analyzed {_MUSIC}""",
       "plays", "tracks", "features")
def totals(spark, sf):
    return stats.totals(*_pt(spark, sf), I.features(spark, sf))


@query("totals_period", f"""SELECT count(DISTINCT track_id) AS tracks_total,
    count(DISTINCT track_id) AS music_tracks, (SELECT count(*) FROM plays) AS listens_total,
    count(*) AS music_listens, {_HOURS} AS hours_est, min(listened_at) AS first_listen,
    max(listened_at) AS last_listen, (SELECT count(*) FROM features) AS analyzed {_MUSIC} AND {_IN}""",
       "plays", "tracks", "features")
def totals_period(spark, sf):
    return stats.totals(*_pt(spark, sf), I.features(spark, sf), FROM, TO)


@query("period_numbers", f"""SELECT count(*) AS listens, {_HOURS} AS hours, count(DISTINCT artist) AS artists,
    count(DISTINCT track_id) AS tracks {_MUSIC} AND {_IN}""", "plays", "tracks")
def period_numbers(spark, sf):
    return stats.period_numbers(*_pt(spark, sf), FROM, TO)


@query("kpi", f"""WITH cur AS (SELECT count(*)::DOUBLE AS listens, {_HOURS} AS hours,
        count(DISTINCT artist)::DOUBLE AS artists, count(DISTINCT track_id)::DOUBLE AS tracks {_MUSIC} AND {_IN}),
    prev AS (SELECT count(*)::DOUBLE AS listens, {_HOURS} AS hours, count(DISTINCT artist)::DOUBLE AS artists,
        count(DISTINCT track_id)::DOUBLE AS tracks {_MUSIC} AND {_PREV}),
    r AS (SELECT 'listens' AS metric, cur.listens AS value, prev.listens AS prev FROM cur, prev
        UNION ALL SELECT 'hours', cur.hours, prev.hours FROM cur, prev
        UNION ALL SELECT 'artists', cur.artists, prev.artists FROM cur, prev
        UNION ALL SELECT 'tracks', cur.tracks, prev.tracks FROM cur, prev)
    SELECT metric, value, prev, CASE WHEN prev <> 0 AND value <> prev
        THEN CAST(floor((value - prev) / prev * 100 + 0.5) AS BIGINT) END AS delta FROM r""", "plays", "tracks")
def kpi(spark, sf):
    return stats.kpi(*_pt(spark, sf), FROM, TO, NOW)


@query("artists", """WITH n AS (SELECT artist, track_id, count(*) AS n, max(listened_at) AS last_at
        FROM plays JOIN tracks USING (track_id) WHERE is_music AND artist <> '' GROUP BY 1, 2),
    top AS (SELECT artist, track_id, row_number() OVER (PARTITION BY artist ORDER BY n DESC, track_id) AS rn FROM n)
    SELECT n.artist, CAST(sum(n) AS BIGINT) AS plays, count(*) AS tracks, max(last_at) AS last_listen,
        any_value(top.track_id) AS top_track_id
    FROM n JOIN top ON top.artist = n.artist AND rn = 1 GROUP BY n.artist
    ORDER BY plays DESC, n.artist LIMIT 20000""", "plays", "tracks")
def artists(spark, sf):
    return stats.artists(*_pt(spark, sf))


@query("artist_top_item", """WITH n AS (SELECT artist, track_id, count(*) AS n FROM plays JOIN tracks USING (track_id)
        WHERE is_music AND artist <> '' GROUP BY 1, 2)
    SELECT artist, track_id AS top_track_id FROM n
    QUALIFY row_number() OVER (PARTITION BY artist ORDER BY n DESC, track_id) = 1""", "plays", "tracks")
def artist_top_item(spark, sf):
    return stats.artist_top_item(*_pt(spark, sf))


@query("artist_summary", f"""WITH n AS (SELECT artist, track_id, title, channel, count(*) AS n,
        min(listened_at) AS f, max(listened_at) AS l {_MUSIC} AND {_IN} GROUP BY ALL),
    top AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY artist ORDER BY n DESC, title, track_id) = 1)
    SELECT n.artist, CAST(sum(n.n) AS BIGINT) AS plays, count(*) AS tracks, min(n.f) AS first_listen,
        max(n.l) AS last_listen, any_value(top.track_id) AS top_track_id, any_value(top.title) AS top_title,
        any_value(top.channel) AS top_channel, any_value(top.n) AS top_plays
    FROM n JOIN top USING (artist) GROUP BY n.artist""", "plays", "tracks")
def artist_summary(spark, sf):
    return stats.artist_summary(*_pt(spark, sf), FROM, TO)


@query("by_hour", """SELECT strftime(listened_at, '%H') AS hour, count(*) AS listens
    FROM listens JOIN tracks USING (track_id) WHERE is_music GROUP BY 1""", "listens", "tracks")
def by_hour(spark, sf):
    return stats.by_hour(I.listens(spark, sf), I.tracks(spark, sf))


@query("by_weekday", f"""SELECT ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(listened_at)] AS weekday,
    count(*) AS listens {_MUSIC} GROUP BY 1""", "plays", "tracks")
def by_weekday(spark, sf):
    return stats.by_weekday(*_pt(spark, sf))


@query("by_month", f"SELECT strftime(listened_at, '%Y-%m') AS month, count(*) AS listens {_MUSIC} GROUP BY 1",
       "plays", "tracks")
def by_month(spark, sf):
    return stats.by_month(*_pt(spark, sf))


@query("by_week", f"""SELECT strftime(date_trunc('week', listened_at), '%Y-%m-%d') AS week, count(*) AS listens
    {_MUSIC} GROUP BY 1""", "plays", "tracks")
def by_week(spark, sf):
    return stats.by_week(*_pt(spark, sf))


@query("timeline", f"""SELECT strftime(date_trunc('week', listened_at), '%Y-%m-%d') AS bucket, count(*) AS listens
    {_MUSIC} AND {_IN} GROUP BY 1""", "plays", "tracks")
def timeline(spark, sf):
    return stats.timeline(*_pt(spark, sf), "week", FROM, TO)


@query("genre_distribution", f"""WITH total AS (SELECT count(*) AS n {_MUSIC}),
    c AS (SELECT genres {_FEAT} AND tags <> ''),
    g AS (SELECT unnest(genres).name AS name FROM c)
    SELECT name, count(*) AS listens, round_even((SELECT count(*) FROM c) / (SELECT n FROM total), 3) AS coverage
    FROM g GROUP BY name ORDER BY listens DESC, name LIMIT 10""", "plays", "tracks", "features")
def genre_distribution(spark, sf):
    return stats.genre_distribution(*_pt(spark, sf), I.features(spark, sf))


# an exact mean: decimal sums do not depend on their order
_MEAN = "CAST(sum(CAST({0} AS DECIMAL(18,9))) AS DOUBLE) / count({0})".format


@query("avg_features", f"""SELECT round_even({_MEAN("tempo")}, 1) AS tempo, round_even({_MEAN("energy")}, 2) AS energy,
    round_even({_MEAN("danceability")}, 2) AS danceability, round_even({_MEAN("acousticness")}, 2) AS acousticness,
    round_even({_MEAN("brightness")}, 2) AS brightness, round_even(count(*) / (SELECT count(*) {_MUSIC}), 3) AS coverage {_FEAT}""",
       "plays", "tracks", "features")
def avg_features(spark, sf):
    return stats.avg_features(*_pt(spark, sf), I.features(spark, sf))


@query("mood_profile", "SELECT " + ", ".join(f"round_even({_MEAN(c)}, 3) AS {c[5:]}" for c in C.MOOD_COLS) + " " + _FEAT,
       "plays", "tracks", "features")
def mood_profile(spark, sf):
    return stats.mood_profile(*_pt(spark, sf), I.features(spark, sf))


@query("by_key", f"""SELECT key, count(*) AS listens {_FEAT} AND key <> '' GROUP BY key
    ORDER BY listens DESC, key LIMIT 12""", "plays", "tracks", "features")
def by_key(spark, sf):
    return stats.by_key(*_pt(spark, sf), I.features(spark, sf))


@query("vocal_split", f"""WITH x AS (SELECT COALESCE(has_vocals, vocal_ratio >= 0.5) AS v {_FEAT})
    SELECT count(*) FILTER (v) AS vocal, count(*) - count(*) FILTER (v) AS instrumental,
        round_even(count(*) / (SELECT count(*) {_MUSIC}), 3) AS coverage FROM x""", "plays", "tracks", "features")
def vocal_split(spark, sf):
    return stats.vocal_split(*_pt(spark, sf), I.features(spark, sf))


@query("language_distribution", """SELECT language, count(*) AS listens FROM plays JOIN tracks USING (track_id)
    JOIN lyrics USING (track_id) WHERE is_music AND text <> '' AND source <> 'whisper' AND language <> ''
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""", "plays", "tracks", "lyrics")
def language_distribution(spark, sf):
    return stats.language_distribution(*_pt(spark, sf), I.lyrics(spark, sf))


@query("mood_trend", f"""SELECT strftime(listened_at, '%Y-%m') AS bucket, round_even({_MEAN("mood_happy")}, 3) AS happy,
    round_even({_MEAN("mood_sad")}, 3) AS sad, round_even({_MEAN("mood_relaxed")}, 3) AS relaxed, round_even({_MEAN("mood_party")}, 3) AS party,
    count(*) AS listens {_FEAT} GROUP BY 1""", "plays", "tracks", "features")
def mood_trend(spark, sf):
    return stats.mood_trend(*_pt(spark, sf), I.features(spark, sf))


_EARLY = (dt.date(1995, 1, 1), dt.date(1995, 3, 31))
_FIRST = "first_at >= TIMESTAMP '1995-01-01' AND first_at < TIMESTAMP '1995-04-01'"
_INQ = _FIRST.replace("first_at", "listened_at")


@query("new_artists", f"""WITH a AS (SELECT artist, count(*) FILTER ({_INQ}) AS plays, min(listened_at) AS first_at
        {_MUSIC} AND artist <> '' GROUP BY 1), f AS (SELECT * FROM a WHERE {_FIRST}),
    n AS (SELECT artist, track_id, count(*) AS n {_MUSIC} GROUP BY 1, 2),
    top AS (SELECT artist, track_id FROM n QUALIFY row_number() OVER (PARTITION BY artist ORDER BY n DESC, track_id) = 1)
    SELECT f.artist AS name, plays, track_id AS top_track_id, (SELECT count(*) FROM f) AS total
    FROM f LEFT JOIN top USING (artist) ORDER BY plays DESC, name LIMIT 8""", "plays", "tracks")
def new_artists(spark, sf):
    return stats.new_artists(*_pt(spark, sf), *_EARLY, n=8, as_of=NOW)


@query("new_tracks", f"""WITH a AS (SELECT track_id, count(*) FILTER ({_INQ}) AS plays, min(listened_at) AS first_at
        {_MUSIC} GROUP BY 1), f AS (SELECT * FROM a WHERE {_FIRST})
    SELECT track_id, title, channel, artist, plays, duration, round_even(tempo, 1) AS tempo, round_even(energy, 2) AS energy,
        (SELECT count(*) FROM f) AS total
    FROM f JOIN tracks USING (track_id) LEFT JOIN (SELECT track_id, tempo, energy FROM features) USING (track_id)
    ORDER BY plays DESC, track_id LIMIT 8""", "plays", "tracks", "features")
def new_tracks(spark, sf):
    return stats.new_tracks(*_pt(spark, sf), I.features(spark, sf), *_EARLY, n=8, as_of=NOW)


@query("coverage", f"""SELECT (SELECT count(*) {_FEAT}) AS covered, count(*) AS listens,
    round_even((SELECT count(*) {_FEAT}) / count(*), 3) AS coverage {_MUSIC}""", "plays", "tracks", "features")
def coverage(spark, sf):
    return stats.coverage(*_pt(spark, sf), I.features(spark, sf))


@query("share", f"""WITH k AS (SELECT strftime(listened_at, '%Y-%m') AS month, count(*) AS listens {_MUSIC} GROUP BY 1)
    SELECT month, listens, CAST(floor(listens / (SELECT sum(listens) FROM k) * 100 + 0.5) AS BIGINT) AS share FROM k""",
       "plays", "tracks")
def share(spark, sf):
    return stats.share(stats.by_month(*_pt(spark, sf)), "listens")


@query("preset_ranges", "WITH p(preset, f) AS (VALUES ('7d', DATE '2001-11-25'), ('30d', DATE '2001-11-02'), "
       "('month', DATE '2001-12-01'), ('year', DATE '2001-01-01'), ('all', DATE '1900-01-01')) "
       "SELECT preset, count(*) AS listens FROM p JOIN plays ON listened_at >= f AND "
       "(preset = 'all' OR listened_at < TIMESTAMP '2001-12-02') JOIN tracks USING (track_id) "
       "WHERE is_music GROUP BY 1", "plays", "tracks")
def preset_ranges(spark, sf):
    """Plays in each named period, one scan with conditional counts."""
    from earlog.functions.columns import in_period
    names = ["7d", "30d", "month", "year", "all"]
    per_track = I.plays(spark, sf).groupBy("track_id").agg(*[
        F.count_if(in_period("listened_at", *base.preset_range(n, NOW))).alias(n) for n in names])
    sums = base.semi(per_track, I.tracks(spark, sf).filter("is_music")).agg(*[F.sum(n).alias(n) for n in names])
    return sums.unpivot([], names, "preset", "listens").filter(F.col("listens") > 0)
