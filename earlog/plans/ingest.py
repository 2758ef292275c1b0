"""History ingest, caches, work queues, errors and backfills."""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from earlog.functions.columns import rounded

from earlog.operators import base, queues as Q
from earlog.plans import inputs as I
from earlog.plans.registry import query
from earlog.plans.sqltext import CURRENT
from earlog.session import ensure_checkpoint_dir
from earlog.sources import features as SF, ingest as N
from earlog.sources.history import normalize_history, read_history

NOW = dt.datetime(2024, 1, 31)


def _history(spark, sf):
    """Export records written from the event log, with all the defects an export has."""
    e = base.spread(I.table(spark, sf, "events").select("event_id", "ts", "event_type", "value", "props"))
    k, v, kind = I.item_of_event(), F.col("value"), F.col("event_type")
    return e.select(
        F.when(kind == "view", "YouTube Музыка").when(kind == "purchase", "").otherwise("YouTube").alias("header"),
        F.when(v < 5, "Liked something").when(v > 200, "Watched a song that is Unavailable now")
        .otherwise(F.concat(F.lit("Watched  title "), k.cast("string"), F.lit(" "), kind)).alias("title"),
        F.when(kind == "signup", "https://example.org/watch?list=abc").otherwise(F.concat(
            F.lit("https://example.org/watch?v="), F.lpad(k.cast("string"), 11, "0"), F.lit("&t=3"))).alias("titleUrl"),
        F.when(kind != "click", F.array(F.struct(F.concat(F.lit("channel "), (k % 7).cast("string"), F.lit(" - Topic"))
                                                 .alias("name"), F.lit("u").alias("url")))).alias("subtitles"),
        F.when(v.between(100, 120), "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("time"),
        F.col("event_id").alias("pos"))


_HIST = """h AS (SELECT event_id AS pos, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, value,
        date_trunc('millisecond', ts) + INTERVAL 1 HOUR AS listened_at FROM events
        WHERE event_type <> 'signup' AND value >= 5 AND value <= 200 AND NOT value BETWEEN 100 AND 120),
    n AS (SELECT lpad(CAST(k AS VARCHAR), 11, '0') AS track_id, 'title ' || k || ' ' || event_type AS title,
        CASE WHEN event_type = 'click' THEN '' ELSE 'channel ' || k % 7 || ' - Topic' END AS channel,
        CASE WHEN event_type = 'view' THEN 'YouTube Музыка' ELSE 'YouTube' END AS header, listened_at, pos FROM h),
    old AS (SELECT DISTINCT track_id, date_trunc('second', listened_at) AS sec FROM n WHERE header = 'YouTube'
        AND channel = ''),
    b AS (SELECT n.* FROM n WHERE (track_id, date_trunc('second', listened_at)) NOT IN (SELECT (track_id, sec) FROM old)
        QUALIFY row_number() OVER (PARTITION BY track_id, date_trunc('second', listened_at) ORDER BY pos) = 1)"""


def _normal(spark, sf):
    return normalize_history(_history(spark, sf), "Europe/Berlin")


def _old(rows):
    return rows.filter((F.col("header") == "YouTube") & (F.col("channel") == ""))


@query("normalize_history", f"WITH {_HIST} SELECT * FROM n")
def history(spark, sf):
    return _normal(spark, sf)


@query("history_scan", f"WITH {_HIST} SELECT track_id, title, channel, header, listened_at FROM n")
def history_scan(spark, sf):
    """The export written out, one record a line, and scanned as files."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    _history(spark, sf).drop("pos").write.json(path)
    return normalize_history(read_history(spark, path, lines=True), "Europe/Berlin").drop("file", "pos")


@query("ingest_listens", f"WITH {_HIST} SELECT * FROM b")
def ingest_listens(spark, sf):
    rows = _normal(spark, sf)
    return N.ingest_listens(rows, _old(rows))


def _catalogue(spark, sf):
    t = I.tracks(spark, sf)
    return t.select(F.lpad(F.col("track_id").cast("string"), 11, "0").alias("track_id"), "title", "channel", "artist_canonical",
                    F.lit("YouTube").alias("header"), F.when(F.col("is_music"), F.lit(None)).otherwise(False).alias("is_music"),
                    "music_reason")


@query("upsert_tracks", f"""WITH {_HIST}, u AS (SELECT track_id, max_by(title, pos) AS t, max_by(channel, pos)
        FILTER (channel <> '') AS c, max_by(header, pos) AS hd, bool_or(header = 'YouTube Музыка') AS app FROM b GROUP BY 1),
    o AS (SELECT lpad(CAST(track_id AS VARCHAR), 11, '0') AS track_id, title, channel, artist_canonical, is_music, music_reason
        FROM tracks)
    SELECT track_id, COALESCE(t, title, '') AS title, COALESCE(c, channel, '') AS channel,
        CASE WHEN hd IS NOT NULL AND COALESCE(c, channel, '') <> '' THEN regexp_replace(COALESCE(c, channel), ' - Topic$', '')
            ELSE COALESCE(artist_canonical, '') END AS artist_canonical, COALESCE(hd, 'YouTube') AS header,
        CASE WHEN app AND (is_music OR is_music IS NULL) THEN true WHEN NOT is_music THEN false END AS is_music,
        CASE WHEN app AND (is_music OR is_music IS NULL) THEN 'yt-music-app' ELSE COALESCE(music_reason, '') END AS music_reason
    FROM o FULL JOIN u USING (track_id)""", "tracks")
def upsert_tracks(spark, sf):
    rows = _normal(spark, sf)
    return N.upsert_tracks(_catalogue(spark, sf), N.ingest_listens(rows, _old(rows)))


@query("refresh_play_count", "SELECT track_id, title, play_count FROM ctracks", "tracks", "ctracks")
def refresh_play_count(spark, sf):
    return N.refresh_play_count(I.tracks(spark, sf), I.plays(spark, sf)).select("track_id", "title", "play_count")


@query("import_summary", f"""WITH {_HIST} SELECT count(*) AS entries, count(DISTINCT track_id) AS items,
    (SELECT count(*) FROM tracks) AS tracks, (SELECT count(*) FROM plays) AS listens FROM b""", "tracks", "plays")
def import_summary(spark, sf):
    rows = _normal(spark, sf)
    return N.import_summary(N.ingest_listens(rows, _old(rows)), I.tracks(spark, sf), I.plays(spark, sf))


def _cache(spark, sf):
    """Cache rows of artists by fetch time: order dates moved next to the reference time."""
    o = I.table(spark, sf, "orders")
    name = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string"))
    return o.select(name.alias("name"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderkey").cast("string"))
                    .alias("mbid"), F.col("o_orderdate").alias("fetched_at"), "o_orderpriority", "o_orderkey",
                    F.col("o_totalprice").alias("price"))


_CACHE = """c AS (SELECT 'Brand#' || (o_custkey % 25 + 1) AS name, CASE WHEN o_orderstatus = 'F' THEN ''
    ELSE CAST(o_orderkey AS VARCHAR) END AS mbid, o_orderdate AS fetched_at, o_orderpriority, o_orderkey, o_totalprice AS price FROM orders)"""


@query("merge_latest", f"""WITH {_CACHE}, d AS (SELECT name, o_orderpriority, max(fetched_at) AS fetched_at, max_by(mbid,
        (fetched_at, o_orderkey)) AS mbid FROM c GROUP BY 1, 2) SELECT name, o_orderpriority, fetched_at, mbid FROM d""")
def merge_latest(spark, sf):
    """Newest cache row per key, the stored part against the fetched part."""
    rows = _cache(spark, sf)
    best = lambda d: d.groupBy("name", "o_orderpriority").agg(F.max_by(F.struct("fetched_at", "mbid", "o_orderkey"),
                                                                       F.struct("fetched_at", "o_orderkey")).alias("v")).select(
        "name", "o_orderpriority", "v.fetched_at", "v.mbid", F.col("v.o_orderkey").alias("no"))
    early = F.col("fetched_at") < "1998-06-01"
    old, new = best(rows.filter(early)), best(rows.filter(~early))
    return N.merge_latest(old, new, ["name", "o_orderpriority"]).drop("no")


@query("artist_queue", f"""WITH {_CACHE}, f AS (SELECT name FROM c WHERE fetched_at >= TIMESTAMP '2001-08-25' - CASE WHEN mbid <> ''
        THEN INTERVAL 30 DAY ELSE INTERVAL 3 DAY END)
    SELECT artist, CAST(sum(play_count) AS BIGINT) AS plays FROM ctracks WHERE is_music AND artist <> ''
        AND artist NOT IN (SELECT name FROM f) GROUP BY 1 ORDER BY plays DESC, artist LIMIT 20""", "tracks", "ctracks")
def artist_queue(spark, sf):
    """Whole cache, some weeks after its last entry: misses have expired, some hits are still fresh."""
    return Q.artists(I.counted_tracks(spark, sf), _cache(spark, sf), dt.datetime(2001, 8, 25), 20)


@query("cache_freshness", f"""WITH {_CACHE} SELECT name, count(*) FILTER (fetched_at >= CASE WHEN mbid <> '' THEN
        TIMESTAMP '2001-07-02' ELSE TIMESTAMP '2001-07-29' END) AS fresh, count(*) AS cached FROM c GROUP BY 1""")
def cache_freshness(spark, sf):
    rows = _cache(spark, sf)
    ok = Q.is_fresh("fetched_at", F.col("mbid") != "", dt.datetime(2001, 8, 1), 30, 3)
    return rows.groupBy("name").agg(F.count_if(ok).alias("fresh"), F.count(F.lit(1)).alias("cached"))


_MARKS = """m AS (SELECT track_id, strftime(max(tried_at), '%Y-%m-%d') AS stamp FROM attempts WHERE error LIKE '%unavailable%'
    OR error LIKE 'ERROR: Video%' GROUP BY 1), un AS (SELECT track_id FROM m WHERE CAST(stamp AS DATE) > DATE '2024-01-21')"""


def _marks(spark, sf):
    dead = I.attempts(spark, sf).filter(Q.error_class("error") == "dead")
    return dead.groupBy("track_id").agg(F.date_format(F.max("tried_at"), "yyyy-MM-dd").alias("stamp"))


@query("unavailable", f"WITH {_MARKS} SELECT track_id FROM un", "attempts")
def unavailable(spark, sf):
    return Q.unavailable(_marks(spark, sf), dt.date(2024, 2, 20))


@query("unavailable_reset", f"""WITH {_MARKS} SELECT count(*) FILTER (track_id IN (SELECT track_id FROM un)) AS cleared,
    count(*) FILTER (track_id NOT IN (SELECT track_id FROM un)) AS marks FROM m""", "attempts")
def unavailable_reset(spark, sf):
    """Marks that still hold are forgotten; their number is observed while they are written."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marks-{uuid.uuid4().hex}"
    marks = _marks(spark, sf)
    cleared = N.reset_marks(marks, path, Q.unavailable(marks, dt.date(2024, 2, 20)))
    return N.published(spark, path, "marks").agg(F.lit(cleared).cast("bigint").alias("cleared"), F.count(F.lit(1)).alias("marks"))


@query("analysis_queue", f"""WITH {_MARKS}, q AS (SELECT track_id, title, play_count FROM ctracks WHERE is_music AND play_count >= 2
        AND track_id NOT IN (SELECT track_id FROM features WHERE source = 'audio' AND feat_version >= 6)
        ORDER BY play_count DESC, track_id LIMIT 700)
    SELECT * FROM q WHERE track_id NOT IN (SELECT track_id FROM un)""", "tracks", "ctracks", "features", "attempts")
def analysis_queue(spark, sf):
    return Q.analysis(I.counted_tracks(spark, sf), I.features(spark, sf), _marks(spark, sf), dt.date(2024, 2, 20), 700)


_VS = """greatest(COALESCE(vocal_ratio, 0), COALESCE(list_max(list_transform(list_filter(instruments,
    lambda g: g.name = 'voice'), lambda g: g.score)), 0))"""


@query("text_queue", f"""SELECT track_id, title, play_count, {_VS} AS score FROM ctracks JOIN features USING (track_id)
    WHERE is_music AND play_count >= 2 AND track_id NOT IN (SELECT track_id * 2 FROM lyrics) ORDER BY play_count DESC, score DESC, track_id LIMIT 100""",
       "tracks", "ctracks", "features", "lyrics")
def text_queue(spark, sf):
    """Every stored text counts as that of an item with an even id; the others have none."""
    done = I.lyrics(spark, sf).withColumn("track_id", F.col("track_id") * 2)
    return Q.texts(I.counted_tracks(spark, sf).drop("duration"), I.features(spark, sf), done, 100)


_CLASS = """CASE WHEN error LIKE 'ERROR: Video%' THEN 'dead' WHEN error LIKE 'Sign in%' THEN 'bot' ELSE 'other' END"""
_NET = "(error LIKE 'HTTP Error 429%' OR error LIKE 'connection%')"


@query("error_classes", f"""SELECT {_CLASS} AS kind, {_NET} AS network, count(*) AS n FROM attempts
    WHERE status = 'dl-error' GROUP BY 1, 2""", "attempts")
def error_classes(spark, sf):
    return Q.error_classes(I.attempts(spark, sf))


def _streak_sql(cond: str, limit: int) -> str:
    return f"""WITH r AS (SELECT *, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER (ORDER BY tried_at, event_id
            ROWS UNBOUNDED PRECEDING) AS run FROM attempts),
        k AS (SELECT run, count(*) FILTER (status = 'dl-error' AND {cond}) AS n FROM r GROUP BY 1)
        SELECT max(n) AS longest, count(*) FILTER (n > 0) AS runs, max(n) >= {limit} AS reached FROM k"""


@query("failure_streaks_bot", _streak_sql("error LIKE 'Sign in%'", 12), "attempts")
def failure_streaks_bot(spark, sf):
    return Q.failure_streaks(I.attempts(spark, sf), "bot")


@query("failure_streaks_network", _streak_sql(_NET, 10), "attempts")
def failure_streaks_network(spark, sf):
    return Q.failure_streaks(I.attempts(spark, sf), "network")


@query("current_errors", f"WITH {CURRENT} SELECT track_id, stage, left(error, 300) AS error, created_at FROM cur WHERE status <> 'ok'",
       "attempts")
def current_errors(spark, sf):
    return Q.current_errors(I.attempts(spark, sf))


@query("list_errors", f"""WITH {CURRENT} SELECT track_id, stage, error, created_at, title, channel, artist FROM cur
    JOIN tracks USING (track_id) WHERE status <> 'ok' ORDER BY created_at DESC, track_id, stage LIMIT 200""",
       "attempts", "tracks")
def list_errors(spark, sf):
    return Q.list_errors(Q.current_errors(I.attempts(spark, sf)), I.tracks(spark, sf))


@query("backfill_vocals", """SELECT track_id, COALESCE(has_vocals, t) AS has_vocals FROM features
    LEFT JOIN (SELECT track_id, true AS t FROM lyrics WHERE text <> '') USING (track_id)""", "features", "lyrics")
def backfill_vocals(spark, sf):
    return Q.backfill_vocals(I.features(spark, sf), I.lyrics(spark, sf)).select("track_id", "has_vocals")


@query("backfill_artist", "SELECT track_id, artist AS artist_canonical FROM tracks", "tracks")
def backfill_artist(spark, sf):
    return Q.backfill_artist(I.tracks(spark, sf)).select("track_id", "artist_canonical")


@query("backfill_duration", """SELECT track_id, COALESCE(NULLIF(duration, 0), m) AS duration FROM tracks
    LEFT JOIN (SELECT vec_id AS track_id, round_even(u[46] * 300, 1) AS m FROM emb) USING (track_id)""", "tracks", "emb")
def backfill_duration(spark, sf):
    m = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("track_id"), rounded(I._unit(46) * 300, 1).alias("measured"))
    return Q.backfill_duration(I.tracks(spark, sf), m).select("track_id", "duration")


@query("video_details", "SELECT * FROM details", "details")
def video_details(spark, sf):
    return N.video_details(I.video_details(spark, sf))


@query("decode_features", """SELECT track_id, CAST(26 AS INTEGER) AS n_mfcc, round_even(list_sum(e[1:26]), 6) AS mfcc_sum,
    round_even(e[27], 6) AS chroma_first, round_even(e[45], 6) AS contrast_last FROM features""", "features")
def decode_features(spark, sf):
    f = SF.decode_vectors(I.raw_features(spark, sf))
    total = F.aggregate("mfcc", F.lit(0.0), lambda a, x: a + x)
    return f.select("track_id", F.size("mfcc").alias("n_mfcc"), rounded(total, 6).alias("mfcc_sum"),
                    rounded(F.get("chroma", F.lit(0)), 6).alias("chroma_first"),
                    rounded(F.element_at("contrast", -1), 6).alias("contrast_last"))


@query("parse_tags", """WITH x AS (SELECT track_id, 'genre' AS part, unnest(genre_vec) AS g FROM features
    UNION ALL SELECT track_id, 'instrument', unnest(instruments) FROM features
    UNION ALL SELECT track_id, 'moodtag', unnest(moodtags) FROM features)
    SELECT track_id, part, g.name AS name, g.score AS score FROM x""", "features")
def parse_tags(spark, sf):
    f = SF.parse_tags(I.raw_features(spark, sf))
    parts = [f.select("track_id", F.lit(p).alias("part"), F.explode(c).alias("name", "score"))
             for p, c in (("genre", "genre_vec"), ("instrument", "instrument_vec"), ("moodtag", "moodtags"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("decode_embedding", """WITH v AS (SELECT vec_id AS track_id, CAST(i AS INTEGER) AS dim, CAST(embedding[i + 1] AS DOUBLE) AS x
        FROM embeddings, range(0, 64) r(i)),
    q AS (SELECT *, CASE WHEN x = 0 THEN 1 ELSE pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) END AS step FROM v)
    SELECT track_id, dim, round_even(x / step, 0) * step AS value FROM q""")
def decode_embedding(spark, sf):
    """Vectors stored as half floats in base64: eleven significant bits are left, rounded half to even."""
    stored = I.half_embeddings(spark, sf).select("track_id", SF.encode_half("embedding").alias("text"))
    return stored.select("track_id", F.posexplode(SF.decode_half("text")).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@query("align_schema", """SELECT track_id, tempo, 0.0::DOUBLE AS energy, 0.5::DOUBLE AS mode_conf, 0.125::DOUBLE AS mood_dark,
    '' AS tags, CAST(0 AS INTEGER) AS feat_version, CAST(NULL AS DOUBLE) AS loudness FROM features""", "features")
def align_schema(spark, sf):
    """A table from before most columns existed."""
    old = I.raw_features(spark, sf).select("track_id", "tempo")
    return SF.align_schema(old).select("track_id", "tempo", "energy", "mode_conf", "mood_dark", "tags", "feat_version", "loudness")
