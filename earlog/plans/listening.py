"""Sessions, co-occurrence, transitions, context scores and external lists."""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from earlog.functions.columns import rounded

from earlog.operators import base, catalog, context, sessions as S, similarity
from earlog.plans import inputs as I
from earlog.plans.registry import query
from earlog.plans.similarity import _TAG_SIM, _TAGS, _map_join
from earlog.session import ensure_checkpoint_dir
from earlog.sources import ingest

NOW = dt.datetime(2024, 1, 31)
GAP, STEP, LIMIT = 720, 240, 200
_NOW = "TIMESTAMP '2024-01-31'"


def _sessions_sql(gap: int, source: str = "listens") -> str:
    return f"""a AS (SELECT l.user_id, l.event_id, l.track_id, l.listened_at,
        lag(l.listened_at) OVER w AS prev_at, lag(l.track_id) OVER w AS prev_track
        FROM {source} l JOIN tracks t USING (track_id) WHERE t.is_music
        WINDOW w AS (PARTITION BY user_id ORDER BY l.listened_at, l.event_id)),
    b AS (SELECT *, prev_at IS NULL OR listened_at - prev_at > INTERVAL {gap} MINUTE AS opens FROM a),
    c AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY listened_at, event_id
        ROWS UNBOUNDED PRECEDING) AS no FROM b),
    s AS (SELECT user_id, no, event_id, track_id, listened_at, CASE WHEN NOT opens THEN prev_at END AS prev_at,
        CASE WHEN NOT opens THEN prev_track END AS prev_track,
        first_value(listened_at) OVER v AS session_start, first_value(event_id) OVER v AS session_event,
        max(listened_at) OVER (PARTITION BY user_id, no) AS last_at
        FROM c WINDOW v AS (PARTITION BY user_id, no ORDER BY listened_at, event_id))"""


_S = _sessions_sql(GAP)
_PAIRS = f"""d AS (SELECT DISTINCT user_id, no, track_id, last_at FROM s),
    k AS (SELECT user_id, no FROM d GROUP BY 1, 2 HAVING count(*) <= {LIMIT}),
    e AS (SELECT d.* FROM d JOIN k USING (user_id, no)),
    co AS (SELECT x.track_id AS track_a, y.track_id AS track_b, count(*) AS cnt, max(x.last_at) AS last_at
        FROM e x JOIN e y ON x.user_id = y.user_id AND x.no = y.no AND x.track_id < y.track_id GROUP BY 1, 2)"""
_NEXT = f"""nx AS (SELECT prev_track AS cur, track_id AS nxt, count(*) AS cnt, max(last_at) AS last_at FROM s
    WHERE prev_track <> track_id AND listened_at - prev_at <= INTERVAL {STEP} MINUTE GROUP BY 1, 2)"""
_DECAY = (f"COALESCE(pow(0.5, greatest(date_diff('second', last_at, {_NOW}) // 86400, 0) / 180.0), 0.5)")


def _music(spark, sf):
    return I.listens(spark, sf), I.tracks(spark, sf)


def _stored(edges):
    """Edges as a build leaves them: written once, read by whoever asks."""
    spark = edges.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/edges-{uuid.uuid4().hex}"
    ingest.write_edges(path, edges=edges)
    return ingest.published(spark, path, "edges")


@query("sessions", f"""WITH {_S} SELECT user_id, event_id, track_id, listened_at, session_start, session_event,
    prev_track, prev_at, last_at AS session_end FROM s""", "listens", "tracks")
def sessions(spark, sf):
    return S._music_sessions(*_music(spark, sf), GAP)


@query("sessions_default_gap", f"""WITH {_sessions_sql(45)} SELECT session_start, user_id, session_event,
    max(listened_at) AS last_at, count(*) AS listens, count(DISTINCT track_id) AS tracks FROM s GROUP BY 1, 2, 3""",
       "listens", "tracks")
def sessions_default_gap(spark, sf):
    return S.with_last_at(S._music_sessions(*_music(spark, sf), 45))


@query("session_guard", f"""WITH {_S} SELECT user_id, session_start, session_event,
    array_to_string(list_sort(list(DISTINCT track_id)), ',') AS ids, max(last_at) AS last_at
    FROM s GROUP BY 1, 2, 3 HAVING count(DISTINCT track_id) <= {LIMIT}""", "listens", "tracks")
def session_guard(spark, sf):
    out = S.guarded(S._music_sessions(*_music(spark, sf), GAP), LIMIT)
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("cooccur", f"WITH {_S}, {_PAIRS} SELECT * FROM co", "listens", "tracks")
def cooccur(spark, sf):
    return S.build_cooccur(*_music(spark, sf), gap_min=GAP, max_tracks=LIMIT)


@query("stored_edges", f"""WITH {_S}, {_PAIRS}, {_NEXT} SELECT 'together' AS kind, track_a AS a, track_b AS b, cnt, last_at FROM co
    UNION ALL SELECT 'next', cur, nxt, cnt, last_at FROM nx""", "listens", "tracks")
def stored_edges(spark, sf):
    """Both edge tables of a build, replaced together and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/edges-{uuid.uuid4().hex}"
    rows = S.sessionize(base.music_listens(*_music(spark, sf)), GAP)
    ingest.write_edges(path, cooccur=S.build_cooccur(None, sessions=rows, max_tracks=LIMIT),
                       following=S.build_next(None, sessions=rows, markov_gap_min=STEP))
    named = lambda name, kind, a, b: ingest.published(spark, path, name).select(                # noqa: E731
        F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), F.col("cnt").cast("bigint").alias("cnt"), "last_at")
    return named("cooccur", "together", "track_a", "track_b").unionByName(named("following", "next", "cur", "nxt"))


@query("next_track", f"WITH {_S}, {_NEXT} SELECT cur, nxt, cnt, last_at FROM nx", "listens", "tracks")
def next_track(spark, sf):
    return S.build_next(*_music(spark, sf), gap_min=GAP, markov_gap_min=STEP).withColumn("cnt", F.col("cnt").cast("bigint"))


@query("co_listened", f"""WITH {_S}, {_PAIRS}, y AS (SELECT track_a AS seed, track_b AS other, cnt, last_at FROM co
        UNION ALL SELECT track_b, track_a, cnt, last_at FROM co), z AS (SELECT *, cnt * {_DECAY} AS sc FROM y)
    SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY sc DESC, other) AS INTEGER) AS rank, other, cnt, last_at,
        round_even(sc, 3) AS score, count(*) OVER (PARTITION BY seed) AS total FROM z QUALIFY rank <= 10""", "listens", "tracks")
def co_listened(spark, sf):
    return S.co_listened(_stored(S.build_cooccur(*_music(spark, sf), gap_min=GAP, max_tracks=LIMIT)), NOW)


@query("next_tracks", f"""WITH {_S}, {_NEXT}, z AS (SELECT cur AS seed, nxt AS other, cnt, last_at,
        (cnt + 1) / (sum(cnt) OVER (PARTITION BY cur) + count(*) OVER (PARTITION BY cur)) AS p FROM nx),
    y AS (SELECT *, p * {_DECAY} AS sc FROM z)
    SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY sc DESC, other) AS INTEGER) AS rank, other, cnt, last_at,
        round_even(p, 3) AS p, round_even(sc, 3) AS score, count(*) OVER (PARTITION BY seed) AS total FROM y QUALIFY rank <= 10""",
       "listens", "tracks")
def next_tracks(spark, sf):
    return S.next_tracks(_stored(S.build_next(*_music(spark, sf), gap_min=GAP, markov_gap_min=STEP)), NOW)


@query("session_stats", f"""WITH {_S}, {_PAIRS}, {_NEXT} SELECT (SELECT count(DISTINCT (user_id, no)) FROM s) AS sessions,
    (SELECT count(*) FROM co) AS pairs, (SELECT count(*) FROM nx) AS transitions,
    (SELECT count(*) FROM (SELECT user_id, no FROM d GROUP BY 1, 2 HAVING count(*) > {LIMIT})) AS oversized""",
       "listens", "tracks")
def session_stats(spark, sf):
    return S.session_stats(*_music(spark, sf), GAP, STEP, LIMIT)


@query("session_stats_plays", f"""WITH {_sessions_sql(60 * 24 * 30, 'uplays')}, d AS (SELECT DISTINCT user_id, no, track_id FROM s),
    k AS (SELECT user_id, no, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT count(*) AS sessions, CAST(sum(n) AS BIGINT) AS items, max(n) AS largest FROM k""", "uplays", "tracks")
def session_stats_plays(spark, sf):
    """Month-gap sessions of every customer over the larger history."""
    facts = S.with_last_at(S._music_sessions(I.plays_by_user(spark, sf), I.tracks(spark, sf), 60 * 24 * 30))
    return facts.agg(F.count(F.lit(1)).alias("sessions"), F.sum("tracks").alias("items"), F.max("tracks").alias("largest"))


@query("turn_transitions", """WITH t AS (SELECT role AS cur, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt
        FROM conversations), n AS (SELECT cur, nxt, count(*) AS cnt FROM t WHERE cur <> nxt GROUP BY 1, 2)
    SELECT cur, nxt, cnt, round_even((cnt + 1) / (sum(cnt) OVER (PARTITION BY cur) + count(*) OVER (PARTITION BY cur)), 3) AS p
    FROM n""")
def turn_transitions(spark, sf):
    """Transitions on a second kind of sequence: roles of consecutive conversation turns."""
    turns = I.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("user_id"), F.col("turn").alias("event_id"), F.col("role").alias("track_id"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(turn AS INT))").alias("listened_at"))
    edges = _stored(S.build_next(turns, gap_min=100000, markov_gap_min=1))
    return S.next_tracks(edges, NOW, 100).select(F.col("seed").alias("cur"), F.col("other").alias("nxt"),
                                                 F.col("cnt").cast("bigint").alias("cnt"), "p")


def _context_sql(hour: int, day: int) -> str:
    return f"""SELECT track_id, count(*) FILTER (hour(listened_at) = {hour}) AS at_hour,
        count(*) FILTER (isodow(listened_at) = {day + 1}) AS at_weekday, count(*) AS plays, max(listened_at) AS last_at
        FROM listens JOIN tracks USING (track_id) WHERE is_music GROUP BY 1"""


_SCORE = f"""(0.6 * (at_hour + 1) / (plays + 24) + 0.4 * (at_weekday + 1) / (plays + 7)) * sqrt(plays + 1) *
    CASE WHEN {_NOW} - last_at < INTERVAL 24 HOUR THEN 0.25 WHEN {_NOW} - last_at < INTERVAL 72 HOUR THEN 0.6 ELSE 1 END"""


@query("for_now", f"""WITH n AS ({_context_sql(18, 2)}), z AS (SELECT *, {_SCORE} AS sc FROM n)
    SELECT track_id, title, channel, artist, plays, at_hour, at_weekday, round_even(sc, 3) AS score,
        COALESCE(NULLIF(concat_ws(', ', CASE WHEN at_hour >= 2 AND at_hour / plays >= 0.25 THEN 'often at 18:00' END,
            CASE WHEN at_weekday >= 2 AND at_weekday / plays >= 0.25 THEN 'on Wednesdays' END), ''),
            'fits this time of day') AS reason, (SELECT count(*) FROM z) AS total
    FROM z JOIN tracks USING (track_id) ORDER BY sc DESC, track_id LIMIT 12""", "listens", "tracks")
def for_now(spark, sf):
    return context.for_now(*_music(spark, sf), 18, 2, NOW)


@query("context_scores", f"""WITH n AS ({_context_sql(7, 5)}) SELECT track_id, at_hour, at_weekday, plays, last_at,
    round_even({_SCORE}, 6) AS score FROM n""", "listens", "tracks")
def context_scores(spark, sf):
    out = context.context_scores(*_music(spark, sf), 7, 5, NOW)
    return out.withColumn("score", rounded("raw_score", 6)).drop("raw_score")


def _radio(spark, sf):
    """External lists: the lines of every order play one radio list, seeded by the item on its first line."""
    line = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("seed_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year")).alias("e"))

    def item(e):
        return F.struct(
            F.when(e["l_quantity"] < 4, "").otherwise(e["l_partkey"].cast("string")).alias("videoId"),
            F.concat(F.lit("Title "), e["l_suppkey"].cast("string")).alias("title"),
            F.array(F.struct(e["l_returnflag"].alias("name")), F.struct(e["l_linestatus"].alias("name"))).alias("artists"),
            F.struct(e["l_linestatus"].alias("name")).alias("album"), e["year"].alias("year"),
            F.concat(F.floor(e["l_quantity"] / 10).cast("string"), F.lit(":"),
                     F.lpad(e["l_quantity"].cast("int").cast("string"), 2, "0")).alias("length"),
            F.array(F.struct(F.lit("small").alias("url"), F.lit(4).alias("width")),
                    F.struct(F.lit("large").alias("url"), e["l_linenumber"].alias("width"))).alias("thumbnail"))
    # plain columns travel, grouped by the id that lists are joined by; the items are built where a list is whole
    entries = line.groupBy("seed_id").agg(F.collect_list("e").alias("es")).select("seed_id", F.sort_array(F.transform("es", lambda e: F.struct(
        e["l_linenumber"].alias("l_linenumber"), e["l_partkey"].alias("l_partkey"), e["l_suppkey"].alias("l_suppkey"), item(e).alias("x")))).alias("xs"))
    return entries.select(
        "seed_id", F.col("xs")[0]["l_partkey"].cast("string").alias("seed_track"),
        F.transform("xs", lambda e: e["x"]).alias("items"),
        F.concat(F.lit("TITLE "), F.array_max(F.transform("xs", lambda e: e["l_suppkey"])).cast("string")).alias("seed_title"))


_RADIO = """x AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn,
        CASE WHEN l_quantity < 4 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS id FROM lineitem l),
    st AS (SELECT l_orderkey, CAST(min_by(l_partkey, rn) AS VARCHAR) AS seed, 'title ' || max(l_suppkey) AS seed_title FROM x GROUP BY 1),
    y AS (SELECT * FROM x WHERE id <> '' QUALIFY row_number() OVER (PARTITION BY l_orderkey, id ORDER BY rn) = 1),
    z AS (SELECT y.*, CAST(row_number() OVER (PARTITION BY y.l_orderkey ORDER BY rn) - 1 AS INTEGER) AS pos, 'Title ' || l_suppkey AS title,
        CASE WHEN id = seed THEN 0 WHEN 'title ' || l_suppkey = seed_title THEN 1 ELSE 2 END AS near FROM y JOIN st USING (l_orderkey)),
    v AS (SELECT *, CAST(l_orderkey AS VARCHAR) AS seed_id, near < 2 AND row_number() OVER (PARTITION BY l_orderkey ORDER BY near, pos) = 1
        AS is_seed FROM z)"""
_RADIO_ROW = """l_returnflag || ', ' || l_linestatus AS artist, l_linestatus AS album,
    strftime(l_shipdate, '%Y') AS year, CASE WHEN l_linenumber > 4 THEN 'large' ELSE 'small' END AS thumbnail"""


@query("external_similar", f"""WITH {_RADIO}, r AS (SELECT track_id, strftime(min(listened_at), '%Y-%m-%d') AS first_listen,
        strftime(max(listened_at), '%Y-%m-%d') AS last_listen FROM plays GROUP BY 1)
    SELECT seed_id, pos, id AS track_id, v.title, {_RADIO_ROW},
        floor(l_quantity / 10) * 60 + l_quantity AS duration, t.track_id IS NOT NULL AS in_history, t.play_count,
        CASE WHEN t.track_id IS NOT NULL THEN first_listen END AS first_listen,
        CASE WHEN t.track_id IS NOT NULL THEN last_listen END AS last_listen
    FROM v LEFT JOIN (SELECT * FROM ctracks WHERE is_music) t ON CAST(t.track_id AS VARCHAR) = id
    LEFT JOIN r ON r.track_id = t.track_id WHERE NOT is_seed""", "plays", "tracks", "ctracks")
def external_similar(spark, sf):
    radio = _radio(spark, sf)
    text_id = F.col("track_id").cast("string")
    tracks = I.counted_tracks(spark, sf).filter("is_music").withColumn("track_id", text_id)
    return context.enrich_external_similar(radio, radio.select("seed_id", "seed_track", "seed_title"), tracks,
                                           I.plays(spark, sf).withColumn("track_id", text_id))


@query("external_match", f"""WITH {_RADIO}, {_TAGS}, cm AS (SELECT CAST(track_id AS VARCHAR) AS id FROM ctracks WHERE is_music)
    SELECT seed_id, pos, v.id AS track_id, CAST(round_even(100 * {_TAG_SIM}, 0) AS INTEGER) AS match FROM v JOIN st USING (l_orderkey)
    JOIN cm ON cm.id = v.id JOIN u a ON CAST(a.track_id AS VARCHAR) = st.seed JOIN u b ON CAST(b.track_id AS VARCHAR) = v.id
    {_map_join('g')} {_map_join('ins')} WHERE NOT is_seed AND a.tagged AND b.tagged""", "plays", "tracks", "ctracks", "features")
def external_match(spark, sf):
    """Listed items of the own history with the tag match to the item that the list is about, in per cent."""
    radio = _radio(spark, sf)
    text_id = F.col("track_id").cast("string")
    tracks = I.counted_tracks(spark, sf).filter("is_music").withColumn("track_id", text_id)
    listed = context.flatten_external(radio).select("seed_id", "track_id").join(radio.select("seed_id", "seed_track"), "seed_id")
    pairs = listed.select(F.col("seed_track").alias("seed_id"), "track_id").distinct()
    match = similarity.pair_match(pairs, I.features(spark, sf).withColumn("track_id", text_id)).withColumnRenamed("seed_id", "seed_track")
    matches = listed.join(match, ["seed_track", "track_id"])
    out = context.enrich_external_similar(radio, radio.select("seed_id", "seed_track", "seed_title"), tracks,
                                          I.plays(spark, sf).withColumn("track_id", text_id), matches)
    return out.filter(F.col("in_history") & F.col("match").isNotNull()).select("seed_id", "pos", "track_id", "match")


@query("external_seed_meta", f"WITH {_RADIO} SELECT seed_id, {_RADIO_ROW} FROM v WHERE is_seed")
def external_seed_meta(spark, sf):
    radio = _radio(spark, sf)
    return context.seed_meta(context.split_seed(context.flatten_external(radio), radio.select("seed_id", "seed_track", "seed_title")))


@query("external_artists", """WITH o AS (SELECT l_orderkey, p_brand, l_returnflag, l_quantity, l_linenumber, l_partkey, l_suppkey
        FROM lineitem JOIN part ON p_partkey = l_partkey), u AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM o WHERE l_returnflag <> 'R' AND l_quantity >= 3),
    p AS (SELECT artist, CAST(sum(play_count) AS BIGINT) AS plays FROM ctracks WHERE is_music AND artist <> ''
        AND artist <> 'Brand#9' GROUP BY 1)
    SELECT CAST(l_orderkey AS VARCHAR) AS mbid, CAST(rn - 1 AS INTEGER) AS pos, p_brand || ' - Topic' AS name,
        CAST(l_partkey AS VARCHAR) AS artist_mbid, CAST(l_quantity AS INTEGER) AS score, COALESCE(plays, 0) AS plays,
        plays IS NOT NULL AS in_history
    FROM u LEFT JOIN p ON artist = p_brand WHERE rn <= 12""", "tracks", "ctracks")
def external_artists(spark, sf):
    """Listed artists per order: usable entries, the kept and the shown ones, own plays."""
    line, part = I.table(spark, sf, "lineitem"), I.table(spark, sf, "part").select("p_partkey", "p_brand")
    key = F.col("l_orderkey").cast("string")
    item = F.struct(F.when(F.col("l_returnflag") == "R", "other").otherwise(key).alias("reference_mbid"),
                    F.col("l_partkey").cast("string").alias("artist_mbid"),
                    F.when(F.col("l_quantity") < 3, "").otherwise(F.concat("p_brand", F.lit(" - Topic"))).alias("name"),
                    F.lit(None).cast("string").alias("comment"), F.lit("Group").alias("type"),
                    F.col("l_quantity").alias("score"))
    lists = (line.join(part, line.l_partkey == part.p_partkey).groupBy(key.alias("mbid"))
             .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("x")))).alias("xs"))
             .select("mbid", F.transform("xs", lambda e: e["x"]).alias("items")))
    totals = catalog.artist_play_totals(I.counted_tracks(spark, sf)).filter(F.col("artist") != "Brand#9")
    return context.enrich_similar_artists(lists, totals).drop("comment", "type")
