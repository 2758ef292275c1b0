"""Catalogue search and library overviews."""
from __future__ import annotations

from pyspark.sql import functions as F

from earlog import config as C
from earlog.functions.columns import rounded
from earlog.functions.labels import GENRES, LANGUAGES, REASONS, map_labels
from earlog.operators import base, catalog, queues, stats, texts, tracks as T
from earlog.plans import inputs as I
from earlog.plans.registry import query
from earlog.plans.sqltext import CURRENT
from earlog.plans.textual import FEELING, STEMS, _sentiment_sql, _topic_sql

_BASE = ("plays", "tracks", "ctracks", "features", "lyrics")
_PROFILE = """prof AS (SELECT t.track_id, t.title, t.channel, t.artist_canonical, t.artist, t.play_count, t.duration,
        t.is_music, t.music_reason, p.first_listen, p.last_listen, f.tempo, f.energy, f.danceability, f.acousticness,
        f.brightness, f.key, f.vocal_ratio, f.has_vocals, f.source AS features_source, f.genres, f.instruments,
        ly.language, ly.source AS text_source, ly.text
    FROM ctracks t LEFT JOIN (SELECT track_id, min(listened_at) AS first_listen, max(listened_at) AS last_listen
        FROM plays GROUP BY 1) p USING (track_id) LEFT JOIN features f USING (track_id)
    LEFT JOIN lyrics ly USING (track_id))"""
_MAXES = ", ".join(f"COALESCE(NULLIF(max({c}), 0), 1) AS {c}" for c in C.MOOD_COLS)
_NORM = ", ".join(f"f.{c} / m.{c} AS {c}" for c in C.MOOD_COLS)
_MOODS = f"""m AS (SELECT {_MAXES} FROM features WHERE source = 'audio'),
    s AS (SELECT track_id, {_NORM} FROM features f, m WHERE source = 'audio'),
    top AS (SELECT *, greatest({', '.join(C.MOOD_COLS)}) AS best FROM s)"""
_ROW = """track_id, title, channel, artist, play_count, duration, strftime(first_listen, '%Y-%m-%d') AS first_listen,
    strftime(last_listen, '%Y-%m-%d') AS last_listen, music_reason, COALESCE(language, '') AS language,
    round_even(tempo, 1) AS tempo, round_even(energy, 2) AS energy, key, has_vocals,
    array_to_string(list_transform(genres, lambda g: g.name), '|') AS genres"""


def _cols():
    return ["track_id", "title", "channel", "artist", "play_count", "duration", "first_listen", "last_listen",
            "music_reason", "language", "tempo", "energy", "key", "has_vocals", F.array_join("genres", "|").alias("genres")]


def _all(spark, sf):
    return I.counted_tracks(spark, sf), I.plays(spark, sf), I.features(spark, sf), I.lyrics(spark, sf)


@query("tracks_query", f"""WITH {_PROFILE}, {CURRENT}, err AS (SELECT DISTINCT track_id FROM cur WHERE status <> 'ok'),
    r AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY play_count DESC NULLS LAST, title, track_id)
        AS position FROM prof WHERE is_music)
    SELECT {_ROW}, total, CAST(position AS INTEGER) AS position, err.track_id IS NOT NULL AS has_error
    FROM r LEFT JOIN err USING (track_id) WHERE position BETWEEN 201 AND 400""", *_BASE, "attempts")
def tracks_query(spark, sf):
    """Second page of the default view."""
    errors = queues.current_errors(I.attempts(spark, sf))
    return T.tracks_query(*_all(spark, sf), errors=errors, page_no=2).select(*_cols(), "total", "position", "has_error")


@query("tracks_page_after", f"""WITH {_PROFILE}, p AS (SELECT *, count(*) OVER () AS total FROM prof WHERE is_music)
    SELECT {_ROW}, total FROM p WHERE play_count < 29 OR (play_count = 29 AND (title > 'hot' OR (title = 'hot' AND track_id > 0)))
    ORDER BY play_count DESC, title, track_id LIMIT 200""", *_BASE)
def tracks_page_after(spark, sf):
    """The rows that follow a given row of the default list: no row is skipped over, the place is a filter."""
    return T.tracks_page_after(*_all(spark, sf), last=(29, "hot", 0)).select(*_cols(), "total")


_GROUPS = """gp AS (SELECT label AS cluster_id, count(*) AS size, 'group ' || label AS name FROM embeddings GROUP BY 1),
    lab AS (SELECT vec_id AS track_id, label AS cluster_id FROM embeddings)"""


@query("tracks_cluster", f"""WITH {_PROFILE}, {_GROUPS}, r AS (SELECT prof.*, cluster_id, name AS cluster_name, count(*) OVER () AS total,
        row_number() OVER (ORDER BY energy DESC NULLS LAST, title, prof.track_id) AS position
        FROM prof JOIN lab USING (track_id) JOIN gp USING (cluster_id) WHERE is_music AND cluster_id = 3)
    SELECT {_ROW}, cluster_id, cluster_name, total, CAST(position AS INTEGER) AS position FROM r WHERE position <= 200""", *_BASE)
def tracks_cluster(spark, sf):
    """Items of one cluster, the liveliest first, with the cluster's name."""
    tracks, groups = _labelled(spark, sf)
    _, plays, features, lyrics = _all(spark, sf)
    return T.tracks_query(tracks, plays, features, lyrics, clusters=groups, sort="energy", cluster_id=3).select(
        *_cols(), "cluster_id", "cluster_name", "total", "position")


@query("tracks_by_tempo", f"""WITH {_PROFILE}, r AS (SELECT *, count(*) OVER () AS total, row_number() OVER
        (ORDER BY tempo ASC NULLS FIRST, title, track_id) AS position FROM prof WHERE is_music AND artist = 'Brand#7')
    SELECT {_ROW}, total, CAST(position AS INTEGER) AS position FROM r WHERE position <= 500""", *_BASE)
def tracks_by_tempo(spark, sf):
    """NULL placement, artist filter and ascending sort."""
    return T.tracks_query(*_all(spark, sf), sort="tempo", order="asc", per_page=500,
                          artist_name="Brand#7").select(*_cols(), "total", "position")


@query("tracks_search", f"""WITH {_PROFILE} SELECT {_ROW} FROM prof WHERE is_music AND (contains(lower(title), 'wid')
    OR contains(lower(channel), 'wid') OR contains(lower(artist_canonical), 'wid'))""", *_BASE)
def tracks_search(spark, sf):
    return T.display(T.select_tracks(*_all(spark, sf), q=" WiD ")).select(*_cols())


@query("tracks_hidden", f"WITH {_PROFILE} SELECT {_ROW} FROM prof WHERE NOT is_music", *_BASE)
def tracks_hidden(spark, sf):
    return T.display(T.select_tracks(*_all(spark, sf), hidden=True)).select(*_cols())


@query("tracks_genre_key", f"""WITH {_PROFILE} SELECT {_ROW} FROM prof WHERE is_music AND key = 'G major'
    AND list_contains(list_transform(genres, lambda g: g.name), 'Jazz')""", *_BASE)
def tracks_genre_key(spark, sf):
    return T.display(T.select_tracks(*_all(spark, sf), genre="Jazz", key="G major")).select(*_cols())


@query("tracks_mood", f"""WITH {_PROFILE}, {_MOODS} SELECT {_ROW} FROM prof
    WHERE is_music AND track_id IN (SELECT track_id FROM top WHERE mood_relaxed >= best)""", *_BASE)
def tracks_mood(spark, sf):
    return T.display(T.select_tracks(*_all(spark, sf), mood="Relaxed")).select(*_cols())


@query("tracks_instrumental", f"""WITH {_PROFILE} SELECT {_ROW} FROM prof WHERE is_music AND (text_source = 'whisper'
    OR (text_source IS NULL AND (has_vocals = false OR (has_vocals IS NULL AND vocal_ratio < 0.3))))""", *_BASE)
def tracks_instrumental(spark, sf):
    return T.display(T.select_tracks(*_all(spark, sf), instrumental=True)).select(*_cols())


@query("tracks_language", f"""WITH {_PROFILE} SELECT {_ROW} FROM prof WHERE is_music AND language = 'fr'
    AND text_source <> 'whisper'""", *_BASE)
def tracks_language(spark, sf):
    return T.display(T.select_tracks(*_all(spark, sf), language="fr")).select(*_cols())


@query("tracks_with_errors", f"""WITH {_PROFILE}, {CURRENT} SELECT {_ROW} FROM prof WHERE is_music
    AND track_id IN (SELECT track_id FROM cur WHERE status <> 'ok')""", *_BASE, "attempts")
def tracks_with_errors(spark, sf):
    errors = queues.current_errors(I.attempts(spark, sf))
    return T.display(T.select_tracks(*_all(spark, sf), errors=errors, only_errors=True)).select(*_cols())


@query("track_profile", f"""WITH {_PROFILE}, {CURRENT}, {_GROUPS}, {_topic_sql()}, {_sentiment_sql()},
    best AS (SELECT track_id, topic FROM t QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY weight DESC, topic) = 1)
    SELECT {_ROW}, COALESCE(text <> '', false) AS has_lyrics, features_source, COALESCE(topic, '') AS topic, cluster_id,
    COALESCE(name, '') AS cluster_name, CASE WHEN p + q > 0 THEN round_even((p - q) / (p + q), 2) WHEN c.track_id IS NOT NULL THEN 0 END AS sentiment,
    CAST(COALESCE(len(genres), 0) AS INTEGER) AS n_genres, round_even(COALESCE(list_sum(list_transform(instruments,
    lambda g: g.score)), 0), 3) AS instrument_total, COALESCE(errs, '') AS errs
    FROM prof LEFT JOIN (SELECT track_id, string_agg(stage || ':' || left(error, 300), '|' ORDER BY created_at DESC, stage DESC, error DESC)
        AS errs FROM cur WHERE status <> 'ok' GROUP BY 1) USING (track_id) LEFT JOIN best USING (track_id) LEFT JOIN lab USING (track_id)
    LEFT JOIN gp USING (cluster_id) LEFT JOIN c USING (track_id)""", *_BASE, "attempts")
def track_profile(spark, sf):
    errors = queues.current_errors(I.attempts(spark, sf))
    tracks, groups = _labelled(spark, sf)
    _, plays, features, lyrics = _all(spark, sf)
    out = T.track_profile(tracks, plays, features, texts.derive(lyrics, STEMS, None, FEELING), groups, errors)
    total = F.aggregate("instrument_scores", F.lit(0.0), lambda a, g: a + g["score"])
    return out.select(*_cols(), "has_lyrics", "features_source", "topic", "cluster_id", "cluster_name", "sentiment",
                      F.when(F.col("genre_scores").isNull(), 0).otherwise(F.size("genre_scores")).alias("n_genres"),
                      rounded(F.coalesce(total, F.lit(0.0)), 3).alias("instrument_total"),
                      F.coalesce(F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["stage"], e["error"])),
                                              "|"), F.lit("")).alias("errs"))


def _case(col: str, pairs: dict) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'"                                # noqa: E731
    return f"CASE {col} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items()) + f" ELSE {col} END"


@query("genres", f"""WITH g AS (SELECT unnest(genres).name AS name FROM features WHERE tags <> ''),
    n AS (SELECT name, count(*) AS count FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40)
    SELECT name, count, {_case('name', GENRES)} AS label
    FROM n WHERE count >= 3""", "features")
def genres(spark, sf):
    return catalog.genres(I.features(spark, sf))


@query("languages", f"""SELECT language AS code, count(*) AS count, {_case('language', LANGUAGES)} AS label FROM lyrics
    WHERE text <> '' AND source <> 'whisper' AND language <> '' GROUP BY language""", "lyrics")
def languages(spark, sf):
    return map_labels(catalog.languages(I.lyrics(spark, sf)), "language", "code")


@query("reason_labels", "SELECT music_reason, CASE WHEN music_reason = '' THEN '—' " + " ".join(
    "WHEN starts_with(music_reason, '{}') THEN '{}'".format(p, lbl) for p, lbl in REASONS)
    + " ELSE music_reason END AS label, count(*) AS tracks FROM tracks GROUP BY 1", "tracks")
def reason_labels(spark, sf):
    counts = I.tracks(spark, sf).groupBy("music_reason").agg(F.count(F.lit(1)).alias("tracks"))
    return map_labels(counts, "reason", "music_reason")


@query("keys", """SELECT key, count(*) AS count FROM features JOIN tracks USING (track_id)
    WHERE is_music AND key <> '' GROUP BY 1""", "features", "tracks")
def keys(spark, sf):
    return catalog.keys(I.features(spark, sf), I.tracks(spark, sf))


@query("mood_counts", f"WITH {_MOODS} " + " UNION ALL ".join(
    f"SELECT '{m}' AS name, count(*) FILTER (mood_{m} = best) AS count FROM top" for m in C.MOODS), "features")
def mood_counts(spark, sf):
    return catalog.mood_counts(I.features(spark, sf))


def _labelled(spark, sf):
    """Clusters given by the label column, as if a clustering job had written them."""
    label = I.raw_features(spark, sf).select("track_id", F.col("label").alias("cluster_id"))
    sizes = label.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).withColumn(
        "name", F.concat(F.lit("group "), F.col("cluster_id").cast("string")))
    return I.counted_tracks(spark, sf).join(label, "track_id", "left"), sizes


@query("clusters", """SELECT label AS cluster_id, count(*) AS size, 'group ' || label AS name FROM embeddings GROUP BY 1""")
def clusters(spark, sf):
    return catalog.clusters(_labelled(spark, sf)[1])


@query("cluster_cards", """WITH c AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1)
    SELECT e.label AS cluster_id, 'group ' || e.label AS name, size, CAST(row_number() OVER (PARTITION BY e.label
        ORDER BY play_count DESC, track_id) AS INTEGER) AS rank, track_id, title, artist, play_count
    FROM ctracks JOIN embeddings e ON vec_id = track_id JOIN c ON c.label = e.label QUALIFY rank <= 15""", "ctracks")
def cluster_cards(spark, sf):
    return catalog.cluster_cards(*_labelled(spark, sf))


@query("artist_play_totals", """SELECT artist, CAST(sum(play_count) AS BIGINT) AS plays FROM ctracks
    WHERE is_music AND artist <> '' GROUP BY 1""", "ctracks")
def artist_play_totals(spark, sf):
    return catalog.artist_play_totals(I.counted_tracks(spark, sf))


@query("artists_view", """SELECT artist, count(*) AS plays, count(DISTINCT track_id) AS tracks,
    max(listened_at) AS last_listen FROM plays JOIN tracks USING (track_id)
    WHERE is_music AND contains(lower(artist), 'd#1') GROUP BY 1""", "plays", "tracks")
def artists_view(spark, sf):
    rows = stats.artists(I.plays(spark, sf), I.tracks(spark, sf)).drop("top_track_id")
    return catalog.artists_view(rows, " D#1", "last_listen", "asc")


@query("analyzed_options", """SELECT track_id, analyzed_at, title, channel, artist, play_count
    FROM features JOIN ctracks USING (track_id)""", "features", "ctracks")
def analyzed_options(spark, sf):
    return catalog.analyzed_options(I.features(spark, sf), I.counted_tracks(spark, sf))


@query("top_tracks", "SELECT track_id, play_count FROM ctracks ORDER BY play_count DESC, track_id LIMIT 25", "ctracks")
def top_tracks(spark, sf):
    return base.top_k(I.counted_tracks(spark, sf).select("track_id", "play_count"), "play_count", "track_id", 25)


@query("apply_overrides", """WITH hide AS (SELECT channel FROM tracks GROUP BY 1 HAVING avg(CASE WHEN is_music THEN 1.0
        ELSE 0 END) < 0.85), it AS (SELECT vec_id AS track_id, label % 2 = 0 AS v FROM embeddings),
    a AS (SELECT track_id, channel, COALESCE(v, is_music) AS m, CASE WHEN v IS NOT NULL THEN 'manual'
        ELSE music_reason END AS r FROM tracks LEFT JOIN it USING (track_id))
    SELECT track_id, CASE WHEN m AND h.channel IS NOT NULL THEN false ELSE m END AS is_music,
        CASE WHEN m AND h.channel IS NOT NULL THEN 'manual-not-music' ELSE r END AS music_reason
    FROM a LEFT JOIN hide h USING (channel)""", "tracks")
def apply_overrides(spark, sf):
    t = I.tracks(spark, sf)
    items = I.raw_features(spark, sf).select("track_id", (F.col("label") % 2 == 0).alias("is_music"))
    return T.apply_overrides(t, items, _rarely_music(t)).select("track_id", "is_music", "music_reason")


def _rarely_music(t):
    share = F.avg(F.when(F.col("is_music"), 1.0).otherwise(0.0))
    return t.groupBy("channel").agg(share.alias("s")).filter("s < 0.85").select("channel")


@query("hidden_count", """SELECT channel, count(*) FILTER (is_music) AS hidden FROM tracks GROUP BY 1
    HAVING avg(CASE WHEN is_music THEN 1.0 ELSE 0 END) < 0.85""", "tracks")
def hidden_count(spark, sf):
    t = I.tracks(spark, sf)
    return T.hidden_count(t, _rarely_music(t))
