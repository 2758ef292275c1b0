"""Classification, titles, topics, sentiment, language, fuzzy matches and model scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from earlog import config as C
from earlog.functions.columns import rounded
from earlog.functions import text as X
from earlog.functions.topics import TOPICS, usable
from earlog.operators import base, classify as K, queues, scores as P, texts as E, tracks as T
from earlog.plans import inputs as I
from earlog.plans.registry import query
from earlog.sources import ingest as N

# rules restricted to what the decorated titles contain; the full patterns are covered by fixtures
_RULES = """r AS (SELECT *, CASE
        WHEN regexp_matches(lower(title), 'review|gameplay') THEN 'anti-pattern'
        WHEN channel LIKE '%- Topic' THEN concat_ws('+', 'topic-channel', hit1)
        WHEN contains(lower(channel), 'vevo') THEN concat_ws('+', 'vevo', hit1)
        WHEN hit1 IS NOT NULL THEN hits
        WHEN strpos(title, ' - ') > 0 AND lower(split_part(title, ' - ', 1)) = lower(channel) THEN 'artist-channel-dash'
        WHEN strpos(title, ' - ') > 0 THEN 'artist-dash' ELSE '' END AS reason0
    FROM (SELECT *, CASE WHEN title LIKE '%(Official Video)' THEN 'official' WHEN title LIKE '% lyrics ft.%' THEN 'lyrics' END
        AS hit1, CASE WHEN title LIKE '%(Official Video)' THEN 'official' WHEN title LIKE '% lyrics ft.%' THEN 'lyrics+feat+audio'
        END AS hits FROM utracks)),
    rv AS (SELECT *, CASE WHEN reason0 = 'anti-pattern' THEN false WHEN reason0 IN ('', 'artist-dash') THEN NULL ELSE true END
        AS verdict0 FROM r)"""
_WEAK = "('artist-dash', 'no-signal', 'channel-music', 'channel-not-music')"
_CASCADE = f"""a AS (SELECT *, is_music IS NULL OR music_reason IN ('anti-pattern', '') OR music_reason IN {_WEAK} AS again FROM rv),
    b AS (SELECT track_id, channel, again AND verdict0 IS NULL AS open,
        CASE WHEN again AND verdict0 IS NOT NULL THEN verdict0 ELSE is_music END AS m,
        CASE WHEN again AND verdict0 IS NOT NULL THEN reason0 ELSE music_reason END AS reason FROM a),
    votes AS (SELECT lower(channel) AS channel_key, count(*) AS n, count(*) FILTER (m) AS n_music FROM b
        WHERE m IS NOT NULL AND channel <> '' AND reason <> '' AND reason NOT IN {_WEAK} GROUP BY 1),
    c AS (SELECT b.*, CASE WHEN open AND n >= 3 THEN CASE WHEN n_music / n >= 0.8 THEN true WHEN n_music / n <= 0.2
        THEN false END END AS v FROM b LEFT JOIN votes ON channel_key = lower(channel))"""


@query("title_rules", f"WITH {_RULES} SELECT track_id, verdict0 AS verdict, reason0 AS reason FROM rv", "utracks")
def title_rules(spark, sf):
    r = K.rules()
    return I.undecided_tracks(spark, sf).select("track_id", r["verdict"].alias("verdict"), r["reason"].alias("reason"))


@query("dash_tests", """SELECT track_id, strpos(title, ' - ') > 0 AS dash,
    strpos(title, ' - ') > 0 AND lower(split_part(title, ' - ', 1)) = lower(channel) AS own FROM utracks""", "utracks")
def dash_tests(spark, sf):
    return I.undecided_tracks(spark, sf).select("track_id", K.is_artist_dash("title").alias("dash"),
                                                K.is_artist_channel_dash("title", "channel").alias("own"))


@query("channel_votes", f"""SELECT lower(channel) AS channel_key, count(*) AS n, count(*) FILTER (is_music) AS n_music
    FROM tracks WHERE music_reason <> '' AND music_reason NOT IN {_WEAK} GROUP BY 1""", "tracks")
def channel_votes(spark, sf):
    return K.channel_votes(I.tracks(spark, sf))


@query("channel_verdicts", f"""SELECT lower(channel) AS channel_key, CASE WHEN count(*) >= 3 THEN CASE
        WHEN count(*) FILTER (is_music) / count(*) >= 0.8 THEN true WHEN count(*) FILTER (is_music) / count(*) <= 0.2
        THEN false END END AS verdict
    FROM tracks WHERE music_reason <> '' AND music_reason NOT IN {_WEAK} GROUP BY 1""", "tracks")
def channel_verdicts(spark, sf):
    votes = K.channel_votes(I.tracks(spark, sf))
    return votes.select("channel_key", K.vote_verdict(F.col("n"), F.col("n_music")).alias("verdict"))


@query("classify", f"""WITH {_RULES}, {_CASCADE} SELECT track_id, CASE WHEN NOT open THEN m WHEN v IS NOT NULL THEN v ELSE false END
        AS is_music, CASE WHEN NOT open THEN reason WHEN v THEN 'channel-music' WHEN NOT v THEN 'channel-not-music'
        ELSE 'no-signal' END AS music_reason FROM c""", "utracks")
def classify(spark, sf):
    return K.classify(I.undecided_tracks(spark, sf)).select("track_id", "is_music", "music_reason")


@query("classify_details", f"""WITH {_RULES}, {_CASCADE} SELECT track_id, CASE WHEN NOT open THEN m WHEN v IS NOT NULL THEN v
        ELSE COALESCE(category_id = 10 AND duration <= 43200, false) END AS is_music,
    CASE WHEN NOT open THEN reason WHEN v THEN 'channel-music' WHEN NOT v THEN 'channel-not-music'
        WHEN d.track_id IS NULL THEN 'api-miss' WHEN category_id IS DISTINCT FROM 10 THEN 'api:not-music'
        WHEN duration > 43200 THEN 'api:too-long' ELSE 'api:cat10' END AS music_reason,
    CASE WHEN open AND v IS NULL THEN duration END AS duration FROM c LEFT JOIN details d USING (track_id)""", "utracks", "details")
def classify_details(spark, sf):
    return K.classify(I.undecided_tracks(spark, sf), N.video_details(I.video_details(spark, sf))).select(
        "track_id", "is_music", "music_reason", "duration")


@query("canonical_artist", """SELECT channel, CASE channel WHEN 'Brand#3 - Topic' THEN 'Brand#3' WHEN 'Brand#4VEVO' THEN 'Brand#4'
    WHEN 'Brand#5 - Official' THEN 'Brand#5' ELSE channel END AS artist, count(*) AS tracks FROM utracks GROUP BY 1""", "utracks")
def canonical_artist(spark, sf):
    return I.undecided_tracks(spark, sf).groupBy("channel").agg(F.count(F.lit(1)).alias("tracks")).withColumn(
        "artist", X.canonical_artist("channel"))


@query("clean_title", r"""WITH s AS (SELECT track_id, channel, regexp_replace(regexp_replace(title,
        '[(\[](official|audio)[^)\]]*[)\]]', '', 'gi'), '\s+', ' ', 'g') AS t FROM utracks),
    p AS (SELECT track_id, channel, trim(t) AS t FROM s)
    SELECT track_id, CASE WHEN strpos(t, ' - ') > 0 THEN split_part(t, ' - ', 1) ELSE '' END AS artist,
        trim(regexp_replace(CASE WHEN strpos(t, ' - ') > 0 THEN split_part(t, ' - ', 2) ELSE t END,
            '\s*ft\.\s.*$', '')) AS song,
        CASE channel WHEN 'Brand#3 - Topic' THEN 'Brand#3' WHEN 'Brand#4VEVO' THEN 'Brand#4' ELSE channel END AS from_channel
    FROM p""", "utracks")
def clean_title(spark, sf):
    c = X.clean_title("title")
    return I.undecided_tracks(spark, sf).select("track_id", c["artist"].alias("artist"), c["song"].alias("song"),
                                                X.artist_from_channel("channel").alias("from_channel"))


# stems cut from the corpus itself: the texts are invented words
STEMS = {"first": {"fr": ["ou", "eau", "le"], "": ["th", "in"]}, "second": {"fr": ["ai", "pa"], "": ["er", "on", "es"]},
         "third": {"fr": ["vi"], "": ["re", "the", "nd"]}}
FEELING = {"fr": (["ou", "eau"], ["le", "re", "eaux"]), "": (["th", "the", "in"], ["er", "on"])}


def _topic_sql(src: str = "lyrics", stems: dict = STEMS, out: str = "t") -> str:
    languages = sorted({g for by in stems.values() for g in by if g})

    def n(topic, lang):
        some = usable(stems[topic].get(lang, []))
        return f"len(list_filter(w, lambda x: regexp_matches(x, '^(?:{'|'.join(some)})')))"

    def by_language(topic):
        cases = " ".join(f"WHEN language = '{g}' THEN {n(topic, g)}" for g in languages)
        return f"CASE {cases} ELSE {n(topic, '')} END" if cases else n(topic, "")
    cols = ", ".join(f"{by_language(t)} AS n{i}" for i, t in enumerate(stems))
    total = " + ".join(f"n{i}" for i in range(len(stems)))
    rows = " UNION ALL ".join(f"SELECT track_id, '{t}' AS topic, n{i} AS n, {total} AS total FROM {out}_k" for i, t in enumerate(stems))
    return f"""{out}_w AS (SELECT track_id, language, regexp_extract_all(lower(text), '[a-zа-яё]+') AS w FROM {src}),
        {out}_k AS (SELECT track_id, {cols} FROM {out}_w), {out} AS (SELECT track_id, topic, round_even(n / total, 4) AS weight FROM ({rows}) WHERE n > 0)"""


def _topics(spark, sf):
    return E.topics(I.lyrics(spark, sf), STEMS)


def _long_topics(rows):
    return rows.select("track_id", F.explode_outer("topics").alias("topic", "weight")).filter(F.col("topic").isNotNull())


@query("topics", f"WITH {_topic_sql()} SELECT * FROM t", "lyrics")
def topics(spark, sf):
    return _long_topics(_topics(spark, sf))


@query("topics_default", f"WITH {_topic_sql(stems=TOPICS)} SELECT * FROM t", "lyrics")
def topics_default(spark, sf):
    """The bundled stems, which serve every language without its own."""
    return _long_topics(E.topics(I.lyrics(spark, sf)))


@query("backfill_topics", f"""WITH {_topic_sql()}, {_topic_sql(stems=TOPICS, out="d")},
    s AS (SELECT t.* FROM t JOIN lyrics USING (track_id) WHERE source <> 'whisper')
    SELECT * FROM s UNION ALL SELECT d.* FROM d WHERE track_id NOT IN (SELECT track_id FROM s)""", "lyrics")
def backfill_topics(spark, sf):
    """Texts are stored with topics, transcripts without; what has none is derived with the bundled stems."""
    none = F.create_map().cast("map<string,double>")
    stored = _topics(spark, sf).withColumn("topics", F.when(F.col("source") != "whisper", F.col("topics")).otherwise(none))
    return _long_topics(queues.backfill_topics(stored, E.topic_weights("text", "language")))


@query("dominant_topic", f"""WITH {_topic_sql()}, b AS (SELECT track_id, topic FROM t QUALIFY row_number() OVER (PARTITION BY track_id
        ORDER BY weight DESC, topic) = 1) SELECT track_id, COALESCE(topic, '') AS topic FROM lyrics LEFT JOIN b USING (track_id)""",
       "lyrics")
def dominant_topic(spark, sf):
    return _topics(spark, sf).select("track_id", T.dominant_topic("topics", list(STEMS)).alias("topic"))


def _sentiment_sql(src: str = "lyrics", language: str = "language") -> str:
    def n(stems):
        return " + ".join(f"(length(x) - length(replace(x, '{s}', ''))) // {len(s)}" for s in stems)

    def pick(i):
        return f"CASE WHEN {language} = 'fr' THEN {n(FEELING['fr'][i])} ELSE {n(FEELING[''][i])} END"
    return f"""c AS (SELECT track_id, {pick(0)} AS p, {pick(1)} AS q FROM (SELECT *, lower(text) AS x FROM {src}))"""


@query("sentiment", f"WITH {_sentiment_sql()} SELECT track_id, CASE WHEN p + q > 0 THEN round_even((p - q) / (p + q), 2) ELSE 0 END "
       "AS sentiment FROM c", "lyrics")
def sentiment(spark, sf):
    return I.lyrics(spark, sf).select("track_id", E.sentiment("text", "language", FEELING).alias("sentiment"))


@query("sentiment_default", "WITH x AS (SELECT track_id, lower(text) AS t FROM lyrics), c AS (SELECT track_id, "
       + ", ".join("(" + " + ".join(f"(length(t) - length(replace(t, '{s}', ''))) // {len(s)}" for s in stems) + f") AS {n}"
                   for n, stems in (("p", E.EN_POSITIVE), ("q", E.EN_NEGATIVE)))
       + " FROM x) SELECT track_id, CASE WHEN p + q > 0 THEN round_even((p - q) / (p + q), 2) ELSE 0 END AS sentiment FROM c", "lyrics")
def sentiment_default(spark, sf):
    return I.lyrics(spark, sf).select("track_id", E.sentiment("text", F.lit("en")).alias("sentiment"))


def _lang_sql(src: str = "lyrics") -> str:
    return rf"""g AS (SELECT track_id, language, unnest(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3)))
            AS gram FROM (SELECT track_id, language, ' ' || regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g') || ' ' AS s
            FROM {src} WHERE text <> '')),
        n AS (SELECT language, gram, count(*) AS c FROM g WHERE language <> '' GROUP BY 1, 2),
        p AS (SELECT language, gram, ln((c + 1) / (sum(c) OVER (PARTITION BY language) + count(*) OVER (PARTITION BY language))) AS logp FROM n)"""


def _detect_sql(src: str = "lyrics") -> str:
    return f"""{_lang_sql(src)}, gk AS (SELECT track_id, gram, count(*) AS c FROM g WHERE trim(gram) <> '' GROUP BY 1, 2),
        gs AS (SELECT track_id, p.language, round_even(sum(c * (logp + 14)), 6) AS s FROM gk JOIN p USING (gram) GROUP BY 1, 2),
        gb AS (SELECT track_id, language FROM gs QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY s DESC, language) = 1),
        det AS (SELECT track_id, COALESCE(gb.language, '') AS detected FROM {src} LEFT JOIN gb USING (track_id))"""


@query("language_profiles", f"WITH {_lang_sql()} SELECT language, gram, round_even(logp, 6) AS logp FROM p", "lyrics")
def language_profiles(spark, sf):
    return E.language_profiles(I.lyrics(spark, sf)).withColumn("logp", rounded("logp", 6))


@query("detect_language", f"WITH {_detect_sql()} SELECT track_id, detected FROM det", "lyrics")
def detect_language(spark, sf):
    texts = I.lyrics(spark, sf)
    return E.detect_language(texts, E.language_profiles(texts))


_BARE = "ul AS (SELECT * REPLACE (CASE WHEN source = 'whisper' THEN '' ELSE language END AS language) FROM lyrics)"


@query("derive_texts", f"""WITH {_BARE}, {_detect_sql("ul")},
    full_ul AS (SELECT ul.* REPLACE (COALESCE(NULLIF(language, ''), detected) AS language), detected FROM ul JOIN det USING (track_id)),
    {_topic_sql("full_ul")}, {_sentiment_sql("full_ul", "detected")}
    SELECT track_id, language, CASE WHEN p + q > 0 THEN round_even((p - q) / (p + q), 2) ELSE 0 END AS sentiment,
        CAST(COALESCE(m, 0) AS INTEGER) AS n_topics
    FROM full_ul JOIN c USING (track_id) LEFT JOIN (SELECT track_id, count(*) AS m FROM t GROUP BY 1) USING (track_id)""", "lyrics")
def derive_texts(spark, sf):
    """Transcripts come without a language: it is read off their text, then sentiment and topics go by it."""
    bare = I.lyrics(spark, sf).withColumn("language", F.when(F.col("source") == "whisper", "").otherwise(F.col("language")))
    out = E.derive(bare, STEMS, E.language_profiles(bare), FEELING)
    return out.select("track_id", "language", "sentiment", F.size("topics").alias("n_topics"))


# Longest common block, leftmost in the first and then in the second text, then the same to its left and right.
_RATIO = """seg AS (SELECT x, y, x AS a, y AS b, CAST(0 AS BIGINT) AS m FROM pr UNION ALL
    SELECT x, y, p.a, p.b, CASE WHEN p.left THEN k ELSE 0 END FROM (SELECT x, y, best.k AS k, unnest([
            {'a': a[:-best.i - 1], 'b': b[:-best.j - 1], 'left': true}, {'a': a[best.k - best.i:], 'b': b[best.k - best.j:], 'left': false}]) AS p
        FROM (SELECT x, y, a, b, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(list_filter(range(1, length(b) + 1),
                lambda j: a[i] = b[j]), lambda j: {'k': len(list_filter(range(1, least(length(a) - i, length(b) - j) + 2),
                lambda n: a[i:i + n - 1] = b[j:j + n - 1])), 'i': -i, 'j': -j})))) AS best FROM seg WHERE a <> '' AND b <> '') WHERE best.k > 0)),
    ra AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 1 ELSE 2 * sum(m) / (length(x) + length(y)) END AS ratio FROM seg GROUP BY 1, 2)"""
_CLEAN = r"""s AS (SELECT track_id, channel, regexp_replace(regexp_replace(title, '[(\[](official|audio)[^)\]]*[)\]]', '', 'gi'), '\s+', ' ', 'g') AS t FROM utracks),
    p AS (SELECT track_id, channel, trim(t) AS t FROM s),
    cl AS (SELECT track_id, channel, trim(regexp_replace(CASE WHEN strpos(t, ' - ') > 0 THEN split_part(t, ' - ', 2) ELSE t END, '\s*ft\.\s.*$', '')) AS song,
        CASE channel WHEN 'Brand#3 - Topic' THEN 'Brand#3' WHEN 'Brand#4VEVO' THEN 'Brand#4' ELSE channel END AS artist FROM p)"""


def _plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\w\\s]+', '', 'g'))"


@query("best_match", f"""WITH RECURSIVE {_CLEAN}, ca AS (SELECT l_partkey AS track_id, l_orderkey * 10 + l_linenumber AS pos, l_suppkey AS cand_id,
        c.channel AS cand_artist, c.song AS cand_song FROM lineitem JOIN cl c ON c.track_id = l_suppkey
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY pos) <= 8),
    mt AS (SELECT ca.track_id, pos, cand_id, {_plain("artist || ' ' || song")} AS wanted, {_plain("cand_artist || ' ' || cand_song")} AS offered,
        {_plain("song")} AS song, {_plain("cand_song")} AS cand_song FROM ca JOIN cl USING (track_id) WHERE song <> ''),
    pr AS (SELECT wanted AS x, offered AS y FROM mt UNION SELECT song, cand_song FROM mt), {_RATIO},
    fu AS (SELECT track_id, cand_id, ratio FROM mt JOIN ra ON x = wanted AND y = offered WHERE ratio >= 0.6
        QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY ratio DESC, pos) = 1),
    al AS (SELECT track_id, cand_id, ratio FROM mt JOIN ra ON x = song AND y = mt.cand_song WHERE ratio >= 0.6
        AND track_id NOT IN (SELECT track_id FROM fu) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY ratio DESC, pos) = 1)
    SELECT *, ratio >= 0.8 AS confirmed FROM (SELECT * FROM fu UNION ALL SELECT * FROM al)""", "utracks")
def best_match(spark, sf):
    """Candidates of a title are the titles met next to it in the order lines."""
    line = I.table(spark, sf, "lineitem")
    names = I.undecided_tracks(spark, sf).select(F.col("track_id").alias("cand_id"), F.col("channel").alias("cand_artist"),
                                                 X.clean_title("title")["song"].alias("cand_song"))
    cand = line.select(F.col("l_partkey").alias("track_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
                       F.col("l_suppkey").alias("cand_id"))
    return E.best_match(E.search_terms(I.undecided_tracks(spark, sf)), cand.join(names, "cand_id"))


@query("match_artists", """WITH s AS (SELECT channel AS name, p_partkey AS pos, p_brand, p_size * 2 AS score
        FROM utracks JOIN part ON p_partkey = track_id WHERE p_size * 2 >= 75)
    SELECT name, CAST(pos AS VARCHAR) AS id, p_brand AS artist_name, score FROM s
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, pos) = 1""", "utracks")
def match_artists(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    t = I.undecided_tracks(spark, sf)
    found = t.join(p, t.track_id == p.p_partkey).select(
        F.col("channel").alias("name"), F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("id"),
        F.col("p_brand").alias("artist_name"), F.array("p_name").alias("aliases"), (F.col("p_size") * 2).alias("score"))
    return E.match_artists(t.select(F.col("channel").alias("name")), found)


@query("artist_tag_lists", """WITH n AS (SELECT p_brand, name, alt, count(*) AS c FROM (SELECT p_brand, p_name AS name, 0 AS alt FROM part
        UNION ALL SELECT p_brand, p_type, 1 FROM part) WHERE name <> '' GROUP BY ALL),
    f AS (SELECT p_brand, min(alt) AS alt FROM n GROUP BY 1),
    r AS (SELECT p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, name) AS rn FROM n JOIN f USING (p_brand, alt))
    SELECT p_brand AS artist, COALESCE(string_agg(name, '|' ORDER BY rn), '') AS top5, min_by(name, rn) AS top1
    FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN (SELECT * FROM r WHERE rn <= 5) USING (p_brand) GROUP BY 1""")
def artist_tag_lists(spark, sf):
    p = I.table(spark, sf, "part")

    def lists(rows, c):
        counts = rows.filter(F.col(c) != "").groupBy(F.col("p_brand").alias("artist"), F.col(c).alias("name")).agg(
            F.count(F.lit(1)).alias("count"))
        few = base.first_k(counts, ["artist"], [F.col("count").desc(), F.col("name")], 5)
        return few.groupBy("artist").agg(F.sort_array(F.collect_list(F.struct("name", "count"))).alias(c))

    genres = lists(p, "p_name")
    none = F.array().cast("array<struct<name:string,count:bigint>>")
    meta = p.select(F.col("p_brand").alias("artist")).distinct().join(lists(p, "p_type"), "artist", "left").join(
        genres, "artist", "left").withColumns({c: F.coalesce(c, none) for c in ("p_name", "p_type")})
    return meta.select("artist", F.array_join(E.tag_list("p_name", "p_type", 5), "|").alias("top5"),
                       F.get(E.tag_list("p_name", "p_type", 1), F.lit(0)).alias("top1"))


_VS = """greatest(COALESCE(vocal_ratio, 0), COALESCE(list_max(list_transform(list_filter(instruments,
    lambda g: g.name = 'voice'), lambda g: g.score)), 0))"""


@query("vocal_score", f"SELECT track_id, round_even({_VS}, 6) AS score FROM features", "features")
def vocal_score(spark, sf):
    return I.features(spark, sf).select("track_id", rounded(P.vocal_score(), 6).alias("score"))


@query("vocal_verdict", r"""SELECT track_id, len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda w: w <> '')) >= 8 AS has_vocals
    FROM lyrics""", "lyrics")
def vocal_verdict(spark, sf):
    return I.lyrics(spark, sf).select("track_id", E.vocal_verdict(F.col("text")).alias("has_vocals"))


_CAL = f"""cal AS (SELECT f.track_id, {_VS} AS score, ly.track_id IS NOT NULL AS positive FROM features f JOIN tracks t
    USING (track_id) LEFT JOIN (SELECT track_id FROM lyrics WHERE text <> '') ly USING (track_id)
    WHERE f.source = 'audio' AND t.is_music)"""


def _calibration(spark, sf):
    return P.calibration_scores(I.features(spark, sf), I.tracks(spark, sf), I.lyrics(spark, sf))


@query("calibration_scores", f"WITH {_CAL} SELECT track_id, round_even(score, 6) AS score, positive FROM cal",
       "features", "tracks", "lyrics")
def calibration_scores(spark, sf):
    return _calibration(spark, sf).withColumn("score", rounded("score", 6))


@query("vocal_threshold_table", f"""WITH {_CAL}, t AS (SELECT i / 100 AS threshold FROM range(5, 100, 5) r(i)),
    r AS (SELECT threshold, round_even(avg((score >= threshold)::DOUBLE) FILTER (positive), 6) AS recall,
        COALESCE(round_even(avg((score >= threshold)::DOUBLE) FILTER (NOT positive), 6), 0) AS negatives FROM cal, t GROUP BY 1)
    SELECT *, COALESCE(threshold = (SELECT max(threshold) FROM r WHERE recall >= 0.95), false) AS suggested FROM r""",
       "features", "tracks", "lyrics")
def vocal_threshold_table(spark, sf):
    return P.threshold_table(_calibration(spark, sf)).withColumns(
        {"recall": rounded("recall", 6), "negatives": rounded("negatives", 6)})


_DOCS = """d AS (SELECT quality, len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')) AS score
    FROM documents JOIN labels USING (doc_id))"""


def _scored_docs(spark, sf):
    words = F.split("text", " ")
    docs = I.table(spark, sf, "documents").select("doc_id", (F.size(F.array_distinct(words)) / F.size(words)).alias("score"))
    return docs.join(I.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("score_histogram", f"""WITH {_DOCS}, n AS (SELECT quality AS cls, CAST(least(9, floor(score * 10)) AS INTEGER) AS bin,
    count(*) AS n FROM d GROUP BY 1, 2) SELECT cls, bin, n, round_even(n / sum(n) OVER (PARTITION BY cls), 4) AS share FROM n""")
def score_histogram(spark, sf):
    return P.score_histogram(_scored_docs(spark, sf), "quality")


@query("threshold_table", f"""WITH {_DOCS}, t AS (SELECT i / 100 AS threshold FROM range(5, 100, 5) r(i)),
    r AS (SELECT threshold, round_even(avg((score >= threshold)::DOUBLE) FILTER (quality = 1), 6) AS recall,
        round_even(avg((score >= threshold)::DOUBLE) FILTER (quality = 0), 6) AS negatives FROM d, t GROUP BY 1)
    SELECT *, COALESCE(threshold = (SELECT max(threshold) FROM r WHERE recall >= 0.95), false) AS suggested FROM r""")
def threshold_table(spark, sf):
    rows = _scored_docs(spark, sf).withColumn("positive", F.col("quality") == 1)
    return P.threshold_table(rows).withColumns({"recall": rounded("recall", 6), "negatives": rounded("negatives", 6)})


# ---- model scores -------------------------------------------------------------------------------
HEADS = {"style": ["Style---" + g for g in I.GENRES],
         "instrument": ["voice", "acousticguitar", "drummachine", "piano", "bass", "theremin", "drums", "pipeorgan"],
         "theme": ["epic", "action", "dark", "deep", "love", "sexy", "dream", "space", "melodic", "fast"],
         "vocal": ["instrumental", "voice"], "dance": ["not_danceable", "danceable"], "tone": ["dark", "unclear"]}


def _model_scores(spark, sf):
    """Frames of each head, read off consecutive vector elements; the last one holds the classes that are left."""
    heads = F.array(*[F.struct(F.lit(h).alias("head"), F.array(*[F.lit(c) for c in cs]).alias("classes"))
                      for h, cs in HEADS.items()])
    e = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("track_id"), F.posexplode("embedding").alias("i", "x"))
    n = F.size("h.classes")
    rows = e.select("*", F.explode(heads).alias("h"))
    return rows.select("track_id", F.floor(F.col("i") / n).cast("int").alias("frame"), F.col("h.head").alias("head"),
                       F.element_at("h.classes", F.col("i") % n + 1).alias("class"), (F.col("i") % n).alias("class_ord"),
                       F.least(F.lit(1.0), F.abs(F.col("x").cast("double")) * 4).alias("score"))


_POOL = "pool AS (" + " UNION ALL ".join(
    f"""SELECT vec_id AS track_id, '{h}' AS head, {"[" + ", ".join("'" + c.replace("'", "''") + "'" for c in cs) + "]"}[o + 1] AS class,
        o AS class_ord, list_avg(list_filter(u, lambda x, i: (i - 1) % {len(cs)} = o)) AS score
        FROM emb, range({len(cs)}) r(o)""" for h, cs in HEADS.items()) + ")"


@query("pool_frames", f"WITH {_POOL} SELECT track_id, head, class, CAST(class_ord AS INTEGER) AS class_ord, round_even(score, 6) AS score FROM pool",
       "emb")
def pool_frames(spark, sf):
    return P.pool_frames(_model_scores(spark, sf)).withColumn("score", rounded("score", 6))


@query("pool_embeddings", """SELECT label AS track_id, CAST(i - 1 AS INTEGER) AS dim, round_even(avg(e[i]), 6) AS value
    FROM emb, range(1, 65) r(i) GROUP BY 1, 2""", "emb")
def pool_embeddings(spark, sf):
    """Vectors of one label play the frames of one item."""
    frames = I.table(spark, sf, "embeddings").select(F.col("label").alias("track_id"), "embedding")
    return P.pool_embeddings(frames).select("track_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", rounded("value", 6))


def _rank_sql(head: str, name: str, top: int | None, minimum: float) -> str:
    rank = f"rank <= {top} AND " if top else ""
    return f"""WITH {_POOL}, k AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY score DESC, class_ord)
        AS INTEGER) AS rank, {name} AS name, score FROM pool WHERE head = '{head}')
        SELECT track_id, rank, name, round_even(score, 3) AS score FROM k WHERE {rank} score >= {minimum}"""


_PRETTY = "replace(class, '---', ' · ')"


@query("score_genres", _rank_sql("style", _PRETTY, 3, 0.05), "emb")
def score_genres(spark, sf):
    return P.select_scores(P.pool_frames(_model_scores(spark, sf)), "style", "genres")


@query("score_styles", _rank_sql("style", _PRETTY, 20, 0.02), "emb")
def score_styles(spark, sf):
    return P.select_scores(P.pool_frames(_model_scores(spark, sf)), "style", "styles")


@query("score_instruments", _rank_sql("instrument", """CASE class WHEN 'acousticguitar' THEN 'Acoustic guitar'
    WHEN 'drummachine' THEN 'Drum machine' WHEN 'pipeorgan' THEN 'Pipe organ' WHEN 'theremin' THEN 'theremin'
    ELSE upper(class[1]) || class[2:] END""", None, 0.05), "emb")
def score_instruments(spark, sf):
    return P.select_scores(P.pool_frames(_model_scores(spark, sf)), "instrument", "instruments")


@query("score_moodtags", _rank_sql("theme", "class", None, 0.05), "emb")
def score_moodtags(spark, sf):
    return P.select_scores(P.pool_frames(_model_scores(spark, sf)), "theme", "moodtags")


@query("theme_moods", f"WITH {_POOL} SELECT track_id, " + ", ".join(
    f"round_even(avg(score) FILTER (class IN ({', '.join(repr(t) for t in tags)})), 3) AS {m}" for m, tags in P.THEME_MOODS.items())
    + " FROM pool WHERE head = 'theme' GROUP BY 1", "emb")
def theme_moods(spark, sf):
    return P.theme_moods(P.pool_frames(_model_scores(spark, sf)), "theme")


@query("positive_class", f"""WITH {_POOL} SELECT track_id, head, class, round_even(score, 6) AS score FROM pool WHERE
    (head = 'dance' AND class = 'danceable') OR (head = 'tone' AND class = 'dark')
    OR (head IN ('style', 'instrument', 'vocal') AND class_ord = 0) OR (head = 'theme' AND class_ord = 0)""", "emb")
def positive_class(spark, sf):
    return P.positive_class(P.pool_frames(_model_scores(spark, sf))).withColumn("score", rounded("score", 6))


@query("vocal_ratio", f"WITH {_POOL} SELECT track_id, round_even(score, 3) AS vocal_ratio FROM pool WHERE head = 'vocal' AND class = 'voice'",
       "emb")
def vocal_ratio(spark, sf):
    return P.vocal_ratio(P.pool_frames(_model_scores(spark, sf)), "vocal")


@query("style_map_top", """WITH x AS (SELECT track_id, unnest(genre_vec) AS g FROM features),
    r AS (SELECT track_id, g.name AS name, g.score AS score, row_number() OVER (PARTITION BY track_id ORDER BY g.score DESC, g.name)
        AS rn FROM x) SELECT track_id, name, score FROM r WHERE rn <= 3 AND score >= 0.1""", "features")
def style_map_top(spark, sf):
    f = I.features(spark, sf).select("track_id", F.explode(P.map_top_k(F.col("genre_vec"), 3, 0.1)).alias("g"))
    return f.select("track_id", F.col("g.name").alias("name"), F.col("g.score").alias("score"))


@query("tempo_vote", """WITH v AS (SELECT vec_id, CASE WHEN label = 1 THEN NULL ELSE 60 + 400 * abs(e[1]) END AS a,
        CASE WHEN label = 2 THEN 0 ELSE 60 + 400 * abs(e[2]) END AS b, u[3] AS ca, u[4] AS cb FROM emb)
    SELECT vec_id AS track_id, round_even(CASE WHEN a > 0 AND b > 0 THEN CASE WHEN abs(a - b) / greatest(a, b) <= 0.2 OR ca >= cb
        THEN a ELSE b END WHEN a > 0 THEN a WHEN b > 0 THEN b END, 4) AS tempo FROM v""", "emb")
def tempo_vote(spark, sf):
    e = I.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("track_id"), F.when(F.col("label") != 1, F.abs(I._e(1)) * 400 + 60).alias("a"),
        F.when(F.col("label") == 2, 0.0).otherwise(F.abs(I._e(2)) * 400 + 60).alias("b"), I._unit(3).alias("ca"), I._unit(4).alias("cb"))
    return e.select("track_id", rounded(P.tempo_vote("a", "b", "ca", "cb"), 4).alias("tempo"))


@query("energy", """SELECT track_id, round_even(greatest(0.0, least(1.0, (loudness + 45.0) / 45.0)), 3) AS energy FROM features
    WHERE loudness IS NOT NULL""", "features")
def energy(spark, sf):
    rows = I.raw_features(spark, sf).filter(F.col("loudness").isNotNull())
    return rows.select("track_id", P.energy("loudness").alias("energy"))
