"""Vectors, text weights, similar items and artists, clusters."""
from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from earlog import config as C
from earlog.functions.columns import rounded
from earlog.operators import sessions as S, similarity as M, vectors as V
from earlog.plans import inputs as I
from earlog.plans.registry import query
from earlog.plans.textual import STEMS, _topic_sql, _topics
from earlog.session import ensure_checkpoint_dir

_RAW = """raw AS (SELECT track_id, list_concat(e[1:45], [ln(1 + tempo), danceability, COALESCE(percussive, 0.5), energy, acousticness,
        brightness, COALESCE(dynamics, 0), COALESCE(loudness, -20) / 45]) AS vec FROM features
        WHERE source = 'audio' AND feat_version >= 2),
    rl AS (SELECT track_id, channel, i, vec[i] AS v FROM raw LEFT JOIN tracks USING (track_id), range(1, 54) r(i))"""
_SHRINK = f"""{_RAW}, mean AS (SELECT channel, i, avg(v) AS m, count(*) AS n FROM rl WHERE channel <> '' GROUP BY 1, 2),
    sl AS (SELECT track_id, i, CASE WHEN n >= 2 THEN n / (n + 3.0) * v + (1 - n / (n + 3.0)) * m ELSE v END AS v
        FROM rl LEFT JOIN mean USING (channel, i))"""


def _standard(source: str) -> str:
    return f"""st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM {source} GROUP BY 1),
        zl AS (SELECT track_id, i, CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END AS z FROM {source} JOIN st USING (i))"""


_Z = f"{_SHRINK}, {_standard('sl')}, z AS (SELECT track_id, list(z ORDER BY i) AS z FROM zl GROUP BY 1)"


def _long(df, c):
    return df.select("track_id", F.posexplode(c).alias("i", "value")).select(
        "track_id", (F.col("i") + 1).cast("bigint").alias("i"), rounded("value", 6).alias("value"))


@query("raw_vectors", f"WITH {_RAW} SELECT track_id, i, round_even(v, 6) AS value FROM rl", "features", "tracks")
def raw_vectors(spark, sf):
    return _long(V.raw_vectors(I.features(spark, sf)), "vec")


@query("shrunk_vectors", f"WITH {_SHRINK} SELECT track_id, i, round_even(v, 6) AS value FROM sl", "features", "tracks")
def shrunk_vectors(spark, sf):
    return _long(V.shrink_to_artist(V.raw_vectors(I.features(spark, sf)), I.tracks(spark, sf)), "vec")


@query("standardized", f"WITH {_Z} SELECT track_id, i, round_even(z, 6) AS value FROM zl", "features", "tracks")
def standardized(spark, sf):
    rows = V.shrink_to_artist(V.raw_vectors(I.features(spark, sf)), I.tracks(spark, sf))
    return _long(V.standardize(rows), "z")


@query("cluster_space", f"""WITH {_RAW}, {_standard('rl')} SELECT track_id, i, round_even(z * sqrt(CASE WHEN i <= 33 THEN 0.35 WHEN i <= 45
    THEN 0.25 WHEN i <= 48 THEN 0.25 ELSE 0.15 END), 6) AS value FROM (SELECT track_id, CASE WHEN i BETWEEN 34 AND 45 THEN i
    ELSE i END AS i, z FROM zl)""", "features", "tracks")
def cluster_space(spark, sf):
    """Blocks in the order timbre, rhythm, harmony, macro; shown here in vector order."""
    point = V.cluster_space_features(I.features(spark, sf))
    ordered = point.withColumn("point", F.concat(F.slice("point", 1, 33), F.slice("point", 37, 12), F.slice("point", 34, 3),
                                                 F.slice("point", 49, 5)))
    return _long(ordered, "point")


@query("embedding_space", """SELECT track_id, i, round_even(e[i] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS value
    FROM features, range(1, 65) r(i) WHERE source = 'audio'""", "features")
def embedding_space(spark, sf):
    return _long(V.cluster_space_embedding(I.features(spark, sf)), "point")


@query("mood_columns", "SELECT track_id, " + ", ".join(C.MOOD_COLS) + " FROM features", "features")
def mood_columns(spark, sf):
    return I.features(spark, sf).select("track_id", *C.MOOD_COLS)


_NEAR = """near AS (SELECT vec_id AS track_id, vec_id - 1 AS seed_id FROM emb)"""


def _pairs(spark, sf):
    """Given pairs: every item with the one before it."""
    return I.table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("seed_id"), F.col("vec_id").alias("track_id"))


_PREVIOUS = """near AS (SELECT vec_id AS track_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS seed_id FROM emb)"""
#: Ids of one label that one task puts in order.
_SPAN = 1 << 16


def _previous(spark, sf):
    """Given pairs: every item with the one before it of its label, however far their ids lie apart.

    Ids are ordered in ranges; the first one of a range follows the last one of the range before, so no label is sorted whole.
    """
    e = I.table(spark, sf, "embeddings").select("vec_id", "label").where(F.col("vec_id").isNotNull())
    rows = e.withColumn("_range", F.floor(F.col("vec_id") / _SPAN))
    ends = rows.groupBy("label", "_range").agg(F.max("vec_id").alias("_last")).select(
        F.col("label").alias("_label"), F.col("_range").alias("_at"),
        F.lag("_last").over(Window.partitionBy("label").orderBy("_range")).alias("_before"))
    own = F.lag("vec_id").over(Window.partitionBy("label", "_range").orderBy("vec_id"))
    both = rows.withColumn("_own", own).join(ends, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_at")))
    return both.select(F.coalesce("_own", "_before").alias("seed_id"), F.col("vec_id").alias("track_id")).where(F.col("seed_id").isNotNull())


@query("cosine_dist", f"""WITH {_PREVIOUS} SELECT seed_id, track_id, round_even(1 - list_dot_product(a.e, b.e)
    / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS distance
    FROM near JOIN emb a ON a.vec_id = seed_id JOIN emb b ON b.vec_id = track_id""", "emb")
def cosine_dist(spark, sf):
    """Dense distance of given pairs: each vector with the previous one of its label."""
    e = I.table(spark, sf, "embeddings").select("vec_id", "embedding")
    a, b = e.alias("a"), e.alias("b")
    both = _previous(spark, sf).join(a, F.col("a.vec_id") == F.col("seed_id")).join(b, F.col("b.vec_id") == F.col("track_id"))
    return both.select("seed_id", "track_id", rounded(V.cosine_dist(F.col("a.embedding"), F.col("b.embedding")), 6).alias("distance"))


def _map_sql(name: str, column: str, src: str = "features") -> str:
    """Long form, lengths and pair dot products of one map column."""
    return f"""{name}_l AS (SELECT track_id, g.name AS k, g.score AS w FROM (SELECT track_id, unnest({column}) AS g FROM {src})),
        {name}_n AS (SELECT track_id, sqrt(sum(w * w)) AS n FROM {name}_l GROUP BY 1),
        {name}_d AS (SELECT x.track_id AS a, y.track_id AS b, sum(x.w * y.w) AS d FROM {name}_l x JOIN {name}_l y USING (k) GROUP BY 1, 2)"""


def _map_dist(name: str) -> str:
    """Distance of pair (a.track_id, b.track_id), with aliases {name}_na, {name}_nb, {name}_p joined."""
    return f"1 - COALESCE({name}_p.d, 0) / NULLIF({name}_na.n * {name}_nb.n, 0)"


def _map_join(name: str) -> str:
    return f"""LEFT JOIN {name}_n {name}_na ON {name}_na.track_id = a.track_id LEFT JOIN {name}_n {name}_nb ON {name}_nb.track_id = b.track_id
        LEFT JOIN {name}_d {name}_p ON {name}_p.a = a.track_id AND {name}_p.b = b.track_id"""


@query("sparse_cosine", f"""WITH {_PREVIOUS}, {_map_sql('g', 'genre_vec')} SELECT seed_id, near.track_id, round_even({_map_dist('g')}, 6) AS distance
    FROM near JOIN features a ON a.track_id = seed_id JOIN features b ON b.track_id = near.track_id {_map_join('g')}""",
       "emb", "features")
def sparse_cosine(spark, sf):
    f = I.features(spark, sf).select("track_id", "genre_vec")
    a, b = f.select(F.col("track_id").alias("seed_id"), F.col("genre_vec").alias("a")), f.select("track_id", F.col("genre_vec").alias("b"))
    both = _previous(spark, sf).join(a, "seed_id").join(b, "track_id")
    return both.select("seed_id", "track_id", rounded(V.sparse_cosine(F.col("a"), F.col("b")), 6).alias("distance"))


def _tfidf_sql(texts: str, cap: int) -> str:
    return rf"""tx AS ({texts}), sz AS (SELECT language, count(*) AS n FROM tx GROUP BY 1 HAVING count(*) >= 2),
        tf AS (SELECT track_id, language, term, count(*) AS tf FROM (SELECT track_id, language,
            unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM tx) GROUP BY 1, 2, 3),
        voc AS (SELECT language, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY language ORDER BY total DESC, term) <= {cap}),
        wt AS (SELECT track_id, tf.language, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (language, term)
            JOIN sz ON sz.language = tf.language),
        ti AS (SELECT track_id, language, term, w / sqrt(sum(w * w) OVER (PARTITION BY track_id)) AS weight FROM wt)"""


_TEXTS = "SELECT track_id, CASE WHEN language = '' THEN 'en' ELSE language END AS language, text FROM lyrics WHERE text <> '' AND source <> 'whisper'"


@query("tfidf", f"WITH {_tfidf_sql(_TEXTS, 20000)} SELECT track_id, language, term, round_even(weight, 6) AS weight FROM ti", "lyrics")
def tfidf(spark, sf):
    return V.tfidf(I.lyrics(spark, sf)).withColumn("weight", rounded("weight", 6))


@query("text_dist", f"""WITH {_NEAR}, {_tfidf_sql(_TEXTS, 20000)}, l AS (SELECT DISTINCT track_id, language FROM ti)
    SELECT seed_id, near.track_id, round_even(1 - COALESCE(d, 0), 6) AS distance FROM near JOIN l a ON a.track_id = seed_id
    JOIN l b ON b.track_id = near.track_id AND b.language = a.language
    LEFT JOIN (SELECT seed_id AS s, n.track_id AS t, sum(x.weight * y.weight) AS d FROM near n JOIN ti x ON x.track_id = seed_id
        JOIN ti y ON y.track_id = n.track_id AND y.term = x.term AND y.language = x.language GROUP BY 1, 2)
    ON s = seed_id AND t = near.track_id""", "emb", "lyrics")
def text_dist(spark, sf):
    t = V.text_vectors(V.tfidf(I.lyrics(spark, sf)))
    a = t.select(F.col("track_id").alias("seed_id"), F.col("text_lang").alias("lang"), F.col("text_vec").alias("a"))
    b = t.select("track_id", F.col("text_lang").alias("other"), F.col("text_vec").alias("b"))
    # vectors lie by item: only those of the seeds move; languages are compared afterwards, not by a key that would move the rest
    both = _pairs(spark, sf).join(a, "seed_id").join(b, "track_id").where(F.col("lang") == F.col("other"))
    return both.select("seed_id", "track_id", rounded(V.sparse_cosine(F.col("a"), F.col("b")), 6).alias("distance"))


@query("semantic_features", f"""WITH {_topic_sql()}, u AS (SELECT * FROM features WHERE source = 'audio' AND feat_version >= 2),
    {_tfidf_sql(_TEXTS + ' AND track_id IN (SELECT track_id FROM u)', 20000)}
    SELECT u.track_id, len(genre_vec) AS genres, len(instruments) AS instruments, len(moodtags) AS moodtags,
        CASE WHEN ly.track_id IS NULL THEN -1 ELSE COALESCE(n, 0) END AS topics, COALESCE(m, 0) AS terms
    FROM u LEFT JOIN (SELECT track_id FROM lyrics WHERE source <> 'whisper') ly USING (track_id)
    LEFT JOIN (SELECT track_id, count(*) AS n FROM t GROUP BY 1) t2 USING (track_id)
    LEFT JOIN (SELECT track_id, count(*) AS m FROM ti GROUP BY 1) USING (track_id)""", "features", "lyrics")
def semantic_features(spark, sf):
    f = V.semantic_features(V.raw_vectors(I.features(spark, sf)), _topics(spark, sf))
    n = lambda c, none: F.when(F.col(c).isNull(), none).otherwise(F.size(c)).cast("bigint")
    return f.select("track_id", n("genre_vec", 0).alias("genres"), n("instrument_vec", 0).alias("instruments"),
                    n("moodtags", 0).alias("moodtags"), n("topics", -1).alias("topics"), n("text_vec", 0).alias("terms"))


@query("cosine_topk", """WITH p AS (SELECT a.vec_id AS seed, b.vec_id AS other, 1 - list_dot_product(a.e, b.e)
        / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS d FROM emb a JOIN emb b ON a.vec_id <> b.vec_id)
    SELECT seed, other, round_even(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY seed ORDER BY d, other) AS INTEGER) AS rank
    FROM p QUALIFY rank <= 5""", "emb")
def cosine_topk(spark, sf):
    return M.cosine_topk(I.half_embeddings(spark, sf), 5).withColumn("distance", rounded("distance", 6))


_DENSE = ", ".join(f"list_distance(a.z[{s + 1}:{e}], b.z[{s + 1}:{e}]) / sqrt({e - s}.0) AS {g}" for g, (s, e) in C.DENSE_SLICES.items())
_COS = lambda a, b: f"1 - list_dot_product({a}, {b}) / NULLIF(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0)"


def _combine(weights: dict[str, float]) -> str:
    names = [g for g in M.GROUP_ORDER if g in weights]
    top = " + ".join(f"COALESCE({weights[g]} * {g}, 0)" for g in names)
    low = " + ".join(f"CASE WHEN {g} IS NULL THEN 0 ELSE {weights[g]} END" for g in names)
    least = "least(" + ", ".join(f"COALESCE({g}, 1e9)" for g in names) + ")"
    label = "CASE " + " ".join(f"WHEN {g} = {least} THEN '{C.GROUP_LABELS[g]}'" for g in names) + " END"
    return f"({top}) / ({low}) AS d, {label} AS match"


_TRACK_MAPS = ", ".join([_map_sql("g", "genre_vec", "u"), _map_sql("ins", "instruments", "u"), _map_sql("mt", "moodtags", "u")])


_SIMILAR = f"""WITH {_Z}, {_topic_sql()}, u AS (SELECT f.*, z.z, [{', '.join(C.MOOD_COLS)}] AS mv FROM features f JOIN z USING (track_id)),
    {_TRACK_MAPS}, lx AS (SELECT t.* FROM t JOIN lyrics l USING (track_id) WHERE l.source <> 'whisper'),
    tp_n AS (SELECT track_id, sqrt(sum(weight * weight)) AS n FROM lx GROUP BY 1),
    tp_d AS (SELECT x.track_id AS a, y.track_id AS b, sum(x.weight * y.weight) AS d FROM lx x JOIN lx y USING (topic) GROUP BY 1, 2),
    {_tfidf_sql(_TEXTS + ' AND track_id IN (SELECT track_id FROM u)', 20000)},
    tl AS (SELECT DISTINCT track_id, language FROM ti),
    td AS (SELECT x.track_id AS a, y.track_id AS b, sum(x.weight * y.weight) AS d FROM ti x JOIN ti y USING (language, term) GROUP BY 1, 2),
    p AS (SELECT a.track_id AS seed, b.track_id AS other, b.tempo, {_DENSE}, a.key = b.key AND a.mode_conf >= 0.7 AND b.mode_conf >= 0.7 AS same_key,
        {_COS('a.e', 'b.e')} AS embedding, {_COS('a.mv', 'b.mv')} AS m1, {_map_dist('mt')} AS m2, {_map_dist('ins')} AS instruments,
        {_map_dist('g')} AS genre, {_map_dist('tp')} AS topics, CASE WHEN la.language = lb.language THEN 1 - COALESCE(td.d, 0) END AS lyrics
        FROM u a JOIN u b ON a.track_id <> b.track_id {_map_join('g')} {_map_join('ins')} {_map_join('mt')} {_map_join('tp')}
        LEFT JOIN tl la ON la.track_id = a.track_id LEFT JOIN tl lb ON lb.track_id = b.track_id
        LEFT JOIN td ON td.a = a.track_id AND td.b = b.track_id),
    q AS (SELECT * REPLACE (CASE WHEN same_key THEN greatest(0.0, harmony - 0.05) ELSE harmony END AS harmony),
        CASE WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN (m1 + m2) / 2 ELSE COALESCE(m1, m2) END AS moods FROM p),
    r AS (SELECT seed, other, tempo, {_combine(C.TRACK_WEIGHTS)} FROM q)
    SELECT seed, other, CAST(row_number() OVER (PARTITION BY seed ORDER BY d, other) AS INTEGER) AS rank, round_even(d, 3) AS distance,
        match, tempo, (SELECT count(*) - 1 FROM u) AS total FROM r QUALIFY rank <= 6"""


@query("similar_tracks", _SIMILAR, "features", "tracks", "lyrics")
def similar_tracks(spark, sf):
    return M.similar_tracks(I.features(spark, sf), I.tracks(spark, sf), _topics(spark, sf), 6)


@query("similar_for_seeds", f"""SELECT s.* FROM ({_SIMILAR}) s JOIN (SELECT track_id FROM ctracks ORDER BY play_count DESC, track_id LIMIT 20)
    t ON t.track_id = seed""", "features", "tracks", "ctracks", "lyrics")
def similar_for_seeds(spark, sf):
    """Items like the twenty most played ones."""
    top = I.counted_tracks(spark, sf).orderBy(F.col("play_count").desc(), "track_id").limit(20).select(F.col("track_id").alias("id"))
    return M.similar_tracks(I.features(spark, sf), I.tracks(spark, sf), _topics(spark, sf), 6, top)


@query("similar_closeness", """WITH p AS (SELECT a.vec_id AS seed, b.vec_id AS other, 1 - list_dot_product(a.e, b.e)
        / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS d FROM emb a JOIN emb b ON a.vec_id <> b.vec_id),
    q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY seed ORDER BY d, other) <= 5)
    SELECT seed, other, round_even(0.5 + 0.5 * (1 - d / max(d) OVER (PARTITION BY seed)), 3) AS closeness FROM q""", "emb")
def similar_closeness(spark, sf):
    """Display scores of the shown neighbours."""
    return M.closeness(M.cosine_topk(I.half_embeddings(spark, sf), 5)).select("seed", "other", rounded("closeness", 3).alias("closeness"))


_TAGS = f"""u AS (SELECT track_id, genres, instruments, tag_vocal, CASE WHEN tags_ok AND label <> 2 THEN [{', '.join(C.MOOD_COLS)}]
        ELSE list_transform(range(11), lambda x: 0.0::DOUBLE) END AS mv, len(genres) + len(instruments) > 0 AS tagged
        FROM features WHERE source = 'audio'),
    {_map_sql('g', 'genres', 'u')}, {_map_sql('ins', 'instruments', 'u')}"""
_TAG_SIM = f"""round_even(0.30 * (1 - COALESCE({_map_dist('g')}, 1)) + 0.15 * (1 - COALESCE({_map_dist('ins')}, 1))
    + 0.30 * (1 - COALESCE({_COS('a.mv', 'b.mv')}, 1)) + 0.25 * (1 - abs(a.tag_vocal - b.tag_vocal)), 3)"""


@query("similar_by_tags", f"""WITH {_TAGS}, p AS (SELECT a.track_id AS seed, b.track_id AS other, {_TAG_SIM} AS sim
        FROM u a JOIN u b ON a.track_id <> b.track_id {_map_join('g')} {_map_join('ins')} WHERE a.tagged)
    SELECT seed, other, CAST(row_number() OVER (PARTITION BY seed ORDER BY sim DESC, other) AS INTEGER) AS rank,
        round_even(1 - sim, 3) AS distance, (SELECT count(*) - 1 FROM u) AS total FROM p QUALIFY rank <= 6""", "features")
def similar_by_tags(spark, sf):
    return M.similar_by_tags(I.features(spark, sf), 6)


@query("pair_match", f"""WITH {_PREVIOUS}, {_TAGS} SELECT seed_id, near.track_id, {_TAG_SIM} AS similarity FROM near
    JOIN u a ON a.track_id = seed_id JOIN u b ON b.track_id = near.track_id {_map_join('g')} {_map_join('ins')}
    WHERE a.tagged AND b.tagged""", "emb", "features")
def pair_match(spark, sf):
    return M.pair_match(_previous(spark, sf), I.features(spark, sf))


def _mean_map_sql(name: str, column: str) -> str:
    return f"""{name}_l AS (SELECT artist AS track_id, g.name AS k, sum(g.score) / any_value(n) AS w FROM (SELECT artist, unnest({column}) AS g FROM u)
            JOIN (SELECT artist, count(*) AS n FROM u WHERE len({column}) > 0 GROUP BY 1) USING (artist) GROUP BY 1, 2),
        {name}_n AS (SELECT track_id, sqrt(sum(w * w)) AS n FROM {name}_l GROUP BY 1),
        {name}_d AS (SELECT x.track_id AS a, y.track_id AS b, sum(x.w * y.w) AS d FROM {name}_l x JOIN {name}_l y USING (k) GROUP BY 1, 2)"""


def _mean_list(column: str, n: int) -> str:
    return f"(SELECT artist, list(v ORDER BY i) AS v FROM (SELECT artist, i, avg({column}[i]) AS v FROM u, range(1, {n + 1}) r(i) GROUP BY 1, 2) GROUP BY 1)"


@query("similar_artists", f"""WITH {_Z}, u AS (SELECT f.*, z.z, [{', '.join(C.MOOD_COLS)}] AS mv, t.artist FROM features f JOIN z USING (track_id)
        JOIN tracks t USING (track_id) WHERE t.artist <> ''),
    {_mean_map_sql('g', 'genre_vec')}, {_mean_map_sql('ins', 'instruments')}, {_mean_map_sql('mt', 'moodtags')},
    ar AS (SELECT artist AS track_id, x.v AS z, y.v AS e, w.v AS mv, n FROM {_mean_list('z', 53)} x JOIN {_mean_list('e', 64)} y USING (artist)
        JOIN {_mean_list('mv', 11)} w USING (artist) JOIN (SELECT artist, count(*) AS n FROM u GROUP BY 1) USING (artist)),
    p AS (SELECT a.track_id AS seed, b.track_id AS other, b.n, {_DENSE}, {_COS('a.e', 'b.e')} AS embedding, {_COS('a.mv', 'b.mv')} AS m1,
        {_map_dist('mt')} AS m2, {_map_dist('ins')} AS instruments, {_map_dist('g')} AS genre
        FROM ar a JOIN ar b ON a.track_id <> b.track_id {_map_join('g')} {_map_join('ins')} {_map_join('mt')}),
    q AS (SELECT *, CASE WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN (m1 + m2) / 2 ELSE COALESCE(m1, m2) END AS moods FROM p),
    r AS (SELECT seed, other, n, {_combine(C.ARTIST_WEIGHTS)} FROM q),
    f AS (SELECT artist, count(*) AS c, sum(play_count) AS plays FROM ctracks WHERE is_music GROUP BY 1),
    top AS (SELECT artist, track_id FROM ctracks WHERE is_music QUALIFY row_number() OVER (PARTITION BY artist ORDER BY play_count DESC, track_id) = 1)
    SELECT seed, other AS artist, CAST(row_number() OVER (PARTITION BY seed ORDER BY d, other) AS INTEGER) AS rank, round_even(d, 3) AS distance,
        n AS tracks_analyzed, COALESCE(c, 0) AS tracks_total, CAST(COALESCE(plays, 0) AS BIGINT) AS plays, top.track_id AS top_track_id
    FROM r LEFT JOIN f ON f.artist = other LEFT JOIN top ON top.artist = other QUALIFY rank <= 5""", "features", "tracks", "ctracks")
def similar_artists(spark, sf):
    return M.similar_artists(I.features(spark, sf), I.counted_tracks(spark, sf), 5)


def _clustered(spark, sf):
    from earlog.operators import clustering
    feats = I.features(spark, sf)
    return clustering.cluster_tracks(clustering.cluster_space(feats)), feats


@query("clusters_kmeans")
def clusters_kmeans(spark, sf):
    """Named k-means groups. Labels differ between libraries, so there is no SQL form."""
    from earlog.operators import clustering
    labels, feats = _clustered(spark, sf)
    return clustering.cluster_names(clustering.cluster_profile(labels, feats))


@query("cluster_labels")
def cluster_labels(spark, sf):
    from earlog.sources.ingest import assign_clusters
    labels, _ = _clustered(spark, sf)
    return assign_clusters(I.tracks(spark, sf), labels).select("track_id", "cluster_id")


@query("cluster_profile", "SELECT label AS cluster_id, count(*) AS size, round_even(avg(tempo), 4) AS tempo, "
       + ", ".join(f"round_even(avg({c}), 4) AS {c}" for c in C.MOOD_COLS) + " FROM features WHERE source = 'audio' GROUP BY 1", "features")
def cluster_profile(spark, sf):
    """Profiles of given groups: the label column stands in for the labels of a run."""
    from earlog.operators import clustering
    rows = clustering.eligible_rows(I.features(spark, sf))
    out = clustering.cluster_profile(rows.select("track_id", F.col("label").alias("cluster_id")), rows)
    return out.select("cluster_id", "size", *[rounded(c, 4).alias(c) for c in ("tempo", *C.MOOD_COLS)])


def _given(spark, sf):
    """Rows with given groups: the label column stands in for the labels of a run."""
    from earlog.operators import clustering
    rows = clustering.eligible_rows(I.features(spark, sf))
    return rows.select("track_id", F.col("label").alias("cluster_id")), rows


@query("cluster_names", f"""WITH RECURSIVE p AS (SELECT label AS cluster_id, count(*) AS size, avg(CASE WHEN tempo > 0 THEN tempo END) AS tempo,
        {', '.join(f'avg({c}) AS {c}' for c in C.MOOD_COLS)} FROM features WHERE source = 'audio' GROUP BY 1),
    m AS ({' UNION ALL '.join(f"SELECT cluster_id, tempo, {i} AS i, '{n}' AS mood, {c} AS v FROM p" for i, (n, c) in enumerate(zip(C.CLUSTER_NAMES, C.MOOD_COLS)))}),
    r AS (SELECT cluster_id, list(mood ORDER BY v DESC, i) AS r, CASE WHEN any_value(tempo) IS NULL THEN 'part' WHEN any_value(tempo) >= 120
        THEN 'fast' ELSE 'slow' END AS w FROM m GROUP BY 1),
    c AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS k, r[1] || ' · ' || w || ' · mix' AS mix,
        list_concat([r[1], r[1] || ' · ' || w], list_transform(r[2:], lambda x: r[1] || ' · ' || w || ' · ' || x)) AS c FROM r),
    f AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, '' AS name UNION ALL
        SELECT k, list_append(used, n), n FROM (SELECT c.k, used, COALESCE(list_filter(c.c, lambda x: NOT list_contains(used, x))[1], mix) AS n
            FROM f JOIN c ON c.k = f.k + 1))
    SELECT cluster_id, f.name, size, {', '.join(f'round_even({c}, 3) AS {c}' for c in C.MOOD_COLS)} FROM p JOIN c USING (cluster_id) JOIN f USING (k)""",
       "features")
def cluster_names(spark, sf):
    """Names of given groups."""
    from earlog.operators import clustering
    return clustering.cluster_names(clustering.cluster_profile(*_given(spark, sf)))


@query("silhouette", """WITH x AS (SELECT track_id, label, list_transform(e, lambda v: v / greatest(sqrt(list_dot_product(e, e)), 1e-9)) AS x
        FROM features WHERE source = 'audio'),
    g AS (SELECT c, n, q, m FROM (SELECT label AS c, count(*) AS n, avg(list_dot_product(x, x)) AS q FROM x GROUP BY 1) JOIN (SELECT c, list(v ORDER BY i) AS m
        FROM (SELECT label AS c, i, avg(x[i]) AS v FROM x, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1) USING (c)),
    d AS (SELECT track_id, label, c, n, greatest(0, list_dot_product(x, x) + q - 2 * list_dot_product(x, m)) AS d FROM x, g),
    s AS (SELECT track_id, label, max(CASE WHEN c = label AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN c <> label THEN d END) AS b FROM d GROUP BY 1, 2),
    v AS (SELECT label, CASE WHEN a IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM s)
    SELECT label AS cluster_id, count(*) AS size, round_even(avg(s), 6) AS silhouette, round_even((SELECT avg(s) FROM v), 6) AS overall FROM v GROUP BY 1""",
       "features")
def silhouette(spark, sf):
    """How well given groups separate the unit embeddings."""
    from earlog.operators import clustering
    labels, rows = _given(spark, sf)
    out = clustering.silhouette(V.cluster_space_embedding(rows).join(labels, "track_id"))
    return out.withColumns({c: rounded(c, 6) for c in ("silhouette", "overall")})


@query("cluster_membership", """SELECT track_id, f.track_id IS NOT NULL AS has_cluster FROM tracks LEFT JOIN
    (SELECT track_id FROM features WHERE source = 'audio' AND feat_version >= 2) f USING (track_id)""", "tracks", "features")
def cluster_membership(spark, sf):
    """Who has a group after a run and who has none; the groups themselves differ between libraries."""
    from earlog.sources.ingest import assign_clusters
    labels, _ = _clustered(spark, sf)
    return assign_clusters(I.tracks(spark, sf), labels).select("track_id", F.col("cluster_id").isNotNull().alias("has_cluster"))


@query("stored_clusters", """SELECT label AS cluster_id, 'group ' || label AS name, count(*) AS size, count(*) FILTER (t.track_id IS NOT NULL) AS tracks
    FROM features f LEFT JOIN tracks t USING (track_id) WHERE f.source = 'audio' GROUP BY 1""", "features", "tracks")
def stored_clusters(spark, sf):
    """Cluster table and labels, replaced together and read back; the catalogue takes its labels from there."""
    from earlog.sources import ingest
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clusters-{uuid.uuid4().hex}"
    labels, _ = _given(spark, sf)
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    ingest.write_clusters(sizes.withColumn("name", F.concat(F.lit("group "), F.col("cluster_id").cast("string"))), labels, path)
    tracks = ingest.assign_clusters(I.tracks(spark, sf), ingest.published(spark, path, "labels"))
    members = tracks.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("tracks"))
    stored = ingest.published(spark, path, "clusters").select("cluster_id", "name", "size")
    return stored.join(members, "cluster_id", "left").withColumn("tracks", F.coalesce("tracks", F.lit(0)))
