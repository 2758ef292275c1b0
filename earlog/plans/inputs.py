"""Domain tables derived from the bundled Parquet tables.

Each function states how one domain table is read off the generic tables; the same derivation in
SQL is in `sqltext`. Only built-in expressions, so column pruning and filters reach the scans.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earlog import config as C
from earlog.operators import base
from earlog.sources.features import decode_vectors, mood_columns, parse_tags

KEYS = ["C major", "A minor", "G major", "E minor", "D major", "B minor", "F major", "D minor",
        "Bb major", "F# minor"]
GENRES = ["Rock", "Pop", "Jazz", "House", "Techno", "Ambient", "Soul", "Funk", "Disco", "Metal",
          "Heavy Metal", "Trap", "Folk, World, & Country", "Score"]
INSTRUMENTS = ["voice", "piano", "guitar", "drums", "bass", "strings"]
MOODTAGS = ["epic", "dramatic", "dark", "deep", "love", "dream", "space", "melodic"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def listens(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").filter(F.col("event_type") != "error")
    return e.select("event_id", "user_id", item_of_event().alias("track_id"),
                    F.col("ts").alias("listened_at"))


def item_of_event() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def plays(spark, sf) -> DataFrame:
    """Larger, dated history without a listener."""
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("track_id"),
                                               F.col("l_shipdate").alias("listened_at"))


def plays_by_user(spark, sf) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("track_id"),
        F.col("l_shipdate").alias("listened_at"))


def tracks(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("channel"),
        F.when(size % 2 == 0, "").otherwise(F.col("p_brand")).alias("artist_canonical"),
        F.when(size % 5 != 0, size * 10.0).alias("duration"),
        (F.col("p_type") != "ECONOMY").alias("is_music"),
        F.when(size < 10, "topic-channel").when(size < 20, "official+lyrics").when(size < 30, "manual")
        .when(size < 40, "no-signal").otherwise("").alias("music_reason"))


def counted_tracks(spark, sf) -> DataFrame:
    """Catalogue with play counts of the larger history."""
    n = base.play_counts(plays(spark, sf)).select("track_id", F.col("n").alias("play_count"))
    return tracks(spark, sf).join(n, "track_id", "left").withColumn(
        "play_count", F.coalesce("play_count", F.lit(0)).cast("bigint"))


# Vector elements as SQL text: one call per column instead of one per operator keeps planning short.
def _element(i: int) -> str:
    return f"CAST(element_at(embedding, {i}) AS DOUBLE)"


def _scaled(i: int) -> str:
    return f"least(1.0D, abs({_element(i)}) * 4)"


def _e(i: int) -> Column:
    return F.expr(_element(i))


def _unit(i: int) -> Column:
    return F.expr(_scaled(i))


def _list(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _scored(names: list[str], first: int, keep: float) -> str:
    """Array of (name, score) for consecutive vector elements, weak ones dropped; `names` are SQL."""
    entries = ", ".join(f"named_struct('name', {n}, 'score', rint({_scaled(first + j)} * 1000) / 1000)" for j, n in enumerate(names))
    return f"filter(array({entries}), g -> g.score >= {keep}D)"


def raw_features(spark, sf) -> DataFrame:
    """Feature rows as an analyser stores them: vectors and tags are JSON text."""
    genre = [f"element_at({_list(GENRES)}, label + {k + 1})" for k in range(5)]
    quoted = lambda names: [f"'{n}'" for n in names]                               # noqa: E731
    none = "CAST(array() AS ARRAY<STRUCT<name: STRING, score: DOUBLE>>)"
    tags = f"""to_json(named_struct(
        'genres', CASE WHEN label = 7 THEN {none} ELSE {_scored(genre[:3], 32, 0.05)} END,
        'styles', map_from_entries(CASE WHEN label = 6 THEN {none} ELSE {_scored(genre, 32, 0.02)} END),
        'instruments', {_scored(quoted(INSTRUMENTS), 37, 0.3)},
        'moods', map_from_entries(CASE WHEN label = 2 THEN {none} ELSE {_scored(quoted(C.MOOD_COLS), 20, 0.0)} END),
        'moodtags', map_from_entries({_scored(quoted(MOODTAGS), 52, 0.3)}),
        'vocal_ratio', rint({_scaled(31)} * 1000) / 1000))"""
    text = lambda first, n: f"to_json(slice(transform(embedding, x -> CAST(x AS DOUBLE)), {first}, {n}))"
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS track_id", "label", f"CASE WHEN {_element(49)} > 0.25 THEN 'meta' ELSE 'audio' END AS source",
        f"CASE WHEN {_element(50)} > 0.25 THEN 1 WHEN {_element(51)} > 0.15 THEN 5 ELSE 6 END AS feat_version",
        f"rint((abs({_element(1)}) * 400 + 60) * 10) / 10 AS tempo",
        f"least(1.0D, abs({_element(2)}) * 4 + 0.5D) AS mode_conf",
        f"{_scaled(3)} AS energy", f"{_scaled(4)} AS danceability", f"{_scaled(5)} AS acousticness", f"{_scaled(6)} AS brightness",
        f"element_at({_list(KEYS)}, label + 1) AS key",
        f"{text(1, 26)} AS mfcc", f"{text(27, 12)} AS chroma", f"{text(39, 7)} AS contrast",
        f"CASE WHEN label <> 3 THEN {_scaled(46)} END AS percussive", f"CASE WHEN label <> 4 THEN {_element(47)} END AS dynamics",
        f"CASE WHEN label <> 5 THEN -60 * {_scaled(48)} END AS loudness",
        f"CASE WHEN {_element(60)} > 0.2 THEN '' WHEN {_element(60)} < -0.2 THEN '{{broken' ELSE {tags} END AS tags",
        f"CASE WHEN label <> 1 THEN {_scaled(31)} END AS vocal_ratio",
        "CASE label % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_vocals", "embedding",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(vec_id AS INT)) AS analyzed_at")


def features(spark, sf) -> DataFrame:
    """Decoded feature rows with mood columns."""
    return mood_columns(parse_tags(decode_vectors(raw_features(spark, sf))))


def lyrics(spark, sf) -> DataFrame:
    empty = F.coalesce("text", F.lit("")) == ""
    return base.spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source")).select(
        F.col("doc_id").alias("track_id"), "text", F.coalesce("lang", F.lit("")).alias("language"),
        F.when(empty, "none").when(F.col("source") == "src0", "whisper").otherwise("lrclib").alias("source"))


def attempts(spark, sf) -> DataFrame:
    """Log of processing attempts: some events fail with a message chosen by their value."""
    v = F.col("value")
    failed = F.col("event_type").isin("error", "signup")
    message = (F.when(v < 5, "ERROR: Video unavailable. This video is private")
               .when(v < 20, "Sign in to confirm you're not a bot")
               .when(v < 40, "HTTP Error 429: Too Many Requests")
               .when(v < 60, "connection timed out").otherwise("codec not supported"))
    return table(spark, sf, "events").select(
        "event_id", item_of_event().alias("track_id"),
        F.when(F.col("event_type") == "signup", "lyrics").otherwise("audio").alias("stage"),
        F.when(failed, "dl-error").otherwise("ok").alias("status"),
        F.when(failed, message).otherwise("").alias("error"), F.col("ts").alias("tried_at"))


def undecided_tracks(spark, sf) -> DataFrame:
    """Catalogue before classification: titles carry the decorations the rules look for."""
    p = base.spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_name", "p_brand"))
    size, kind, name, brand = F.col("p_size"), F.col("p_type"), F.col("p_name"), F.col("p_brand")
    title = (F.when(kind == "PROMO", F.concat(name, F.lit(" (Official Video)")))
             .when(kind == "ECONOMY", F.concat(name, F.lit(" gameplay review")))
             .when(kind == "SMALL", F.concat(brand, F.lit(" - "), name))
             .when(kind == "LARGE", F.concat(name, F.lit(" [Audio] lyrics ft. someone")))
             .when(kind == "MEDIUM", F.concat(F.lit("some one - "), name)).otherwise(name))
    channel = (F.when(brand == "Brand#3", F.concat(brand, F.lit(" - Topic")))
               .when(brand == "Brand#4", F.concat(brand, F.lit("VEVO")))
               .when(brand == "Brand#5", F.concat(brand, F.lit(" - Official"))).otherwise(brand))
    return p.select(
        F.col("p_partkey").alias("track_id"), title.alias("title"), channel.alias("channel"),
        F.when(size > 45, True).when(size > 40, False).alias("is_music"),
        F.when(size > 47, "manual").when(size > 45, "channel-music").when(size > 43, "manual-not-music")
        .when(size > 40, "anti-pattern").otherwise("").alias("music_reason"),
        F.lit(None).cast("double").alias("duration"))


def video_details(spark, sf) -> DataFrame:
    """Details payload of some items: ISO duration text and category text."""
    p = table(spark, sf, "part")
    size = F.col("p_size")
    return p.filter(size < 35).select(
        F.col("p_partkey").alias("track_id"),
        F.concat(F.lit("PT"), size.cast("string"), F.lit("H"), (size + 1).cast("string"), F.lit("M5S"))
        .alias("duration_iso"),
        F.when(size < 20, "10").when(size < 30, "24").otherwise("n/a").alias("category_id"),
        F.col("p_brand").alias("channel"), F.col("p_name").alias("title"))


def half_embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("track_id"), "embedding")
