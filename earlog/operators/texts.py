"""Text-derived facts: topics, sentiment, language, fuzzy matches, tag lists."""
from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from earlog import config as C
from earlog.functions.columns import col, let, rounded
from earlog.functions.ship import by_value
from earlog.functions.text import artist_from_channel, clean_title, count_substrings, plain, words_collapsed
from earlog.functions.topics import LETTERS, TOPICS, found_by, prefixes
from earlog.operators import base

by_value(__name__)

# --- fixed values: sentiment stems ------------------------------------------------------
RU_POSITIVE = (
    "любл люблю любовь любим мила милая милый нежн нежность счаст счасть "
    "радост свет солнц тёпл тёплы теплые добр друз друг весен цветок небо "
    "мечт вдохнов свобод улыб лето dance").split()
RU_NEGATIVE = (
    "ненавижу боль больно бо боюсь страх страш плак плач слез слёз груст "
    "печал тоск одинок пуст тьм холод зим смерть умер убей прощай разрыв "
    "разбит жесток война кровь раны рыда").split()
EN_POSITIVE = (
    "love lovely beautiful happy sunshine light warm sweet dream hope free "
    "freedom smile dancing summer friend forever heaven shine bright kiss "
    "hold heart soul together alive").split()
EN_NEGATIVE = (
    "hate pain hurt cry crying tears sad lonely alone dark cold death dead "
    "die dying broken break goodbye leaving gone war blood knife fear afraid "
    "scared lost empty miss missing").split()
LANGUAGE_ALIASES = {"zh-cn": "zh", "zh-tw": "zh"}
# --- end of fixed values ----------------------------------------------------------------

SENTIMENT = {"ru": (RU_POSITIVE, RU_NEGATIVE), "": (EN_POSITIVE, EN_NEGATIVE)}


def topic_weights(text: Column | str, language: Column | str, stems: dict[str, dict[str, list[str]]] = TOPICS,
                  letters: str = LETTERS) -> Column:
    """Share of each topic among the words that begin with a topic stem, rounded to four decimals.

    `stems`: topic -> language -> stems; the language '' serves every other language. All topics share one scan of the text: it
    takes the longest stem that a word begins with, and every topic knows the stems that speak for it. Words are not exploded, so
    long texts need no shuffle.
    """
    low, lang = F.lower(F.coalesce(col(text), F.lit(""))), col(language)
    languages = sorted({g for t in stems.values() for g in t if g})
    nothing = F.create_map().cast("map<string,double>")

    def share(g: str) -> Column:
        own = {t: by.get(g, []) for t, by in stems.items()}
        every = [s for ss in own.values() for s in ss]
        pattern = prefixes(every)
        if not pattern:
            return nothing
        found = F.regexp_extract_all(low, F.lit(f"(?<![{letters}]){pattern}"), F.lit(0))

        def weights(hits: Column) -> Column:
            counts = F.array(*[F.struct(F.lit(t).alias("topic"), F.size(F.filter(hits, _among(found_by(ss, every)))).alias("n"))
                               for t, ss in own.items()])

            def shares(rows: Column) -> Column:
                total = F.aggregate(rows, F.lit(0), lambda a, x: a + x["n"])
                kept = F.filter(rows, lambda x: x["n"] > 0)
                return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["topic"], rounded(x["n"] / total, 4))))
            return let(counts, shares)
        return let(found, weights)

    out = F.when(F.lit(False), nothing)
    for g in languages:
        out = out.when(lang == g, share(g))
    return out.otherwise(share(""))


def _among(values: list[str]):
    return lambda s: s.isin(values) if values else F.lit(False)


def topics(lyrics: DataFrame, stems: dict[str, dict[str, list[str]]] = TOPICS) -> DataFrame:
    return lyrics.withColumn("topics", topic_weights("text", "language", stems))


def sentiment(text: Column | str, language: Column | str, stems: dict = SENTIMENT) -> Column:
    """(positive − negative) / (positive + negative) over substring counts, two decimals."""
    low, lang = F.lower(F.coalesce(col(text), F.lit(""))), col(language)

    def score(lists) -> Column:
        found = F.struct(count_substrings(low, lists[0]).alias("p"), count_substrings(low, lists[1]).alias("n"))
        return let(found, lambda f: F.when(f["p"] + f["n"] > 0, rounded((f["p"] - f["n"]) / (f["p"] + f["n"]), 2))
                   .otherwise(0.0))

    out = F.when(F.lit(False), 0.0)
    for g in sorted(k for k in stems if k):
        out = out.when(lang == g, score(stems[g]))
    return out.otherwise(score(stems[""]))


# ---- language ---------------------------------------------------------------------------------
def _grams(df: DataFrame, text: str, n: int) -> DataFrame:
    """Adds `gram`, one row per distinct character n-gram of the letters, with its count `c`."""
    letters = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))
    # an overlapping look-ahead yields all n-grams in one linear scan of the text
    # (outer form: plain explode would repeat the scan in an inferred size filter)
    grams = F.regexp_extract_all(letters, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))
    return df.select("*", F.explode_outer(grams).alias("gram")).filter(F.col("gram").isNotNull())


def language_profiles(labelled: DataFrame, n: int = 3, per_language: int | None = None) -> DataFrame:
    """language, gram, logp: n-grams of each language with the log of their share, smoothed by the language's distinct n-grams.

    With `per_language` only that many of the most frequent ones are returned.
    """
    rows = _grams(labelled.filter((F.col("language") != "") & (F.col("text") != "")).select("language", "text"), "text", n)
    counts = rows.groupBy("language", "gram").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("language").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("grams"))
    best = base.first_k(counts, ["language"], [F.col("c").desc(), F.col("gram")], per_language) if per_language else counts
    return best.join(total, "language").select("language", "gram", F.ln((F.col("c") + 1) / (F.col("total") + F.col("grams"))).alias("logp"))


def detect_language(texts: DataFrame, profiles: DataFrame, n: int = 3, floor: float = -14.0) -> DataFrame:
    """track_id, detected: the language with the largest summed log share; '' without any letter.

    A language that lacks an n-gram gets `floor` for it. Texts move once, by item; an item's n-grams are counted where its texts lie.
    The profiles are stored, so that their size is known when the join is planned: n-grams stay where they are counted while Spark
    finds the profiles small enough to send, and are shuffled otherwise.
    """
    rows = texts.filter(F.col("text") != "").select("track_id", "text").repartition("track_id")
    grams = _grams(rows, "text", n).filter(F.trim("gram") != "")
    counts = grams.groupBy("track_id", "gram").agg(F.count(F.lit(1)).alias("c"))
    scores = counts.join(base.stored(profiles), "gram").groupBy("track_id", "language").agg(F.sum(F.col("c") * (F.col("logp") - floor)).alias("s"))
    best = scores.groupBy("track_id").agg(F.min_by("language", F.struct(-rounded("s", 6), F.col("language"))).alias("detected"))
    code = best.withColumn("detected", F.coalesce(*[F.when(F.col("detected") == k, v) for k, v in LANGUAGE_ALIASES.items()],
                                                  F.col("detected")))
    return texts.select("track_id").join(code, "track_id", "left").withColumn("detected", F.coalesce("detected", F.lit("")))


def with_language(lyrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows with the language of the text where none is known."""
    missing = lyrics.filter((F.col("language") == "") & (F.col("text") != ""))
    return lyrics.join(detect_language(missing, profiles), "track_id", "left").withColumn(
        "language", F.coalesce(F.nullif("language", F.lit("")), "detected", F.lit(""))).drop("detected")


def derive(lyrics: DataFrame, stems: dict = TOPICS, profiles: DataFrame | None = None, feeling: dict = SENTIMENT) -> DataFrame:
    """Language where missing, then sentiment and topics of every text.

    With `profiles` the sentiment goes by the language of the text itself, whatever the row says; topics by the row's language
    where it has one.
    """
    if profiles is None:
        return topics(lyrics.withColumn("sentiment", sentiment("text", "language", feeling)), stems)
    found = detect_language(lyrics.filter(F.col("text") != ""), profiles).withColumnRenamed("detected", "_own")
    rows = lyrics.join(found, "track_id", "left").withColumn("_own", F.coalesce("_own", F.lit("")))
    rows = rows.withColumns({"sentiment": sentiment("text", "_own", feeling),
                             "language": F.coalesce(F.nullif("language", F.lit("")), "_own")}).drop("_own")
    return topics(rows, stems)


# ---- fuzzy matching ----------------------------------------------------------------------------
@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity 0..1 of two short texts; no built-in computes this ratio (edit distance ranks differently)."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio()
                      for x, y in zip(a, b)])


def ratio_bounds(a: Column, b: Column) -> Column:
    """struct(by_length, by_letters): two upper bounds of the matching-blocks ratio, the second never above the first."""
    both = F.struct(a.alias("a"), b.alias("b"))

    def bounds(p: Column) -> Column:
        n, m = F.length(p["a"]), F.length(p["b"])
        count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))                # noqa: E731
        shared = F.aggregate(F.array_distinct(F.split(p["a"], "")), F.lit(0), lambda s, c: s + F.least(count(p["a"], c), count(p["b"], c)))
        part = lambda x: F.when(n + m > 0, 2.0 * x / (n + m)).otherwise(1.0)                   # noqa: E731
        return F.struct(part(F.least(n, m)).alias("by_length"), part(shared).alias("by_letters"))
    return let(both, bounds)


def possible(rows: DataFrame, a: Column, b: Column, minimum: float, sure: Column | None = None) -> DataFrame:
    """Adds `_a`, `_b`, `_sure` and drops the pairs that cannot reach the ratio; only what is left and not sure needs the matcher."""
    rows = rows.withColumns({"_a": a, "_b": b})
    rows = rows.withColumn("_sure", F.coalesce((F.col("_a") == F.col("_b")) if sure is None else sure, F.lit(False)))
    n, m = F.length("_a"), F.length("_b")
    rows = rows.where(F.col("_sure") | (2 * F.least(n, m) >= minimum * (n + m)))
    return rows.where(F.col("_sure") | (ratio_bounds(F.col("_a"), F.col("_b"))["by_letters"] >= minimum))


def with_ratio(rows: DataFrame, out: str) -> DataFrame:
    """`out`: 1 where the texts are equal, else the ratio of those that are not sure otherwise (NULL for them)."""
    mine = lambda c: F.when(~F.col("_sure"), F.col(c))                              # noqa: E731
    return rows.withColumn(out, F.coalesce(F.when(F.col("_a") == F.col("_b"), 1.0), block_ratio(mine("_a"), mine("_b")))).drop("_a", "_b")


def search_terms(tracks: DataFrame) -> DataFrame:
    """What to look a text up by: artist (channel first, else from the title) and song."""
    c = clean_title("title")
    own = F.nullif(artist_from_channel("channel"), F.lit(""))
    return tracks.select("track_id", F.coalesce(own, c["artist"]).alias("artist"), c["song"].alias("song"))


def match_texts(terms: DataFrame, candidates: DataFrame, first: int | None = 8) -> DataFrame:
    """Each item's first candidates (None: all) with the cleaned texts that are compared."""
    few = candidates if first is None else base.first_k(candidates, ["track_id"], [F.col("pos")], first)
    cand = F.concat_ws(" ", F.coalesce("cand_artist", F.lit("")), F.coalesce("cand_song", F.lit("")))
    wanted = terms.filter(F.col("song") != "").select("track_id", plain(F.concat_ws(" ", "artist", "song")).alias("wanted"), plain("song").alias("song"))
    return few.join(wanted, "track_id").select("track_id", "pos", "cand_id", "wanted", plain(cand).alias("offered"), "song",
                                               plain("cand_song").alias("cand_song"))


def best_match(terms: DataFrame, candidates: DataFrame, first: int | None = 8, minimum: float = C.MATCH_RATIO,
               confirm: float = C.CONFIRM_RATIO) -> DataFrame:
    """Best candidate of each item among its first ones, and whether it proves the item has words.

    `terms`: track_id, artist, song; `candidates`: track_id, pos, cand_artist, cand_song, cand_id.
    The ratio on 'artist song' decides; where none reaches `minimum`, the ratio on the song alone. Lengths and letter counts
    drop the pairs that cannot reach it, so the matcher sees few.
    """
    rows = match_texts(terms, candidates, first)

    def within(a: str, b: str) -> Column:
        n, m = F.length(a), F.length(b)
        return (F.col(a) == F.col(b)) | ((2 * F.least(n, m) >= minimum * (n + m))
                                         & (ratio_bounds(F.col(a), F.col(b))["by_letters"] >= minimum))

    def reached(open_: Column, a: str, b: str) -> Column:
        mine = lambda c: F.when(open_ & (F.col(a) != F.col(b)), F.col(c))            # noqa: E731
        ratio = F.when(open_ & (F.col(a) == F.col(b)), 1.0).otherwise(block_ratio(mine(a), mine(b)))
        return F.when(ratio >= minimum, ratio)
    # one pass over the pairs of an item: the song alone is compared where no pair of the item has reached the ratio
    pairs = rows.withColumns({"_f": within("wanted", "offered"), "_s": within("song", "cand_song")}).where(F.col("_f") | F.col("_s"))
    full = pairs.withColumn("_full", reached(F.col("_f"), "wanted", "offered")).withColumn(
        "_none", F.max("_full").over(Window.partitionBy("track_id")).isNull())
    found = full.withColumn("_alone", reached(F.col("_none") & F.col("_s"), "song", "cand_song")).withColumn(
        "ratio", F.when(F.col("_none"), F.col("_alone")).otherwise(F.col("_full")))
    # pairs below the ratio have none and are passed over; a filter here would run the matcher again
    order = F.when(F.col("ratio").isNotNull(), F.struct(-F.col("ratio"), F.col("pos")))
    best = found.groupBy("track_id").agg(F.min_by("cand_id", order).alias("cand_id"), F.max("ratio").alias("ratio"))
    return best.where(F.col("ratio").isNotNull()).withColumn("confirmed", F.col("ratio") >= confirm)


def names_alike(query: Column, name: Column) -> Column:
    """Equal, or contained when the query has four letters."""
    return (query == name) | ((F.length(query) >= 4) & (F.contains(query, name) | F.contains(name, query)))


def match_artists(queries: DataFrame, artists: DataFrame, minimum: int = C.ARTIST_MATCH_SCORE, alike: float = 0.8) -> DataFrame:
    """Best found artist of each query whose name or alias looks like it: equal, contained, or a ratio of at least `alike`.

    `queries`: name; `artists` (search results): name, pos, id, artist_name, aliases, score.
    """
    usable = artists.filter((F.coalesce("score", F.lit(0)) >= minimum) & (F.coalesce("id", F.lit("")) != ""))
    names = F.array_union(F.array(F.coalesce("artist_name", F.lit(""))), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = usable.join(queries.select("name").distinct(), "name").select(
        "name", "pos", "id", "artist_name", "score", F.explode(names).alias("alias"))
    q, c = words_collapsed("name"), words_collapsed("alias")
    close = possible(rows.where((q != "") & (c != "")), q, c, alike, names_alike(F.col("_a"), F.col("_b")))
    found = with_ratio(close, "_r").where(F.col("_sure") | (F.col("_r") >= alike))
    best = found.groupBy("name").agg(F.min_by(F.struct("id", "artist_name", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("e"))
    return best.select("name", "e.id", "e.artist_name", "e.score")


def tag_list(genres: Column | str, tags: Column | str, n: int) -> Column:
    """Names of the n most counted genres, tags when there are no genres."""
    def names(entries: Column) -> Column:
        good = F.filter(entries, lambda e: F.coalesce(e["name"], F.lit("")) != "")
        ranked = F.array_sort(F.transform(good, lambda e, i: F.struct(-F.coalesce(e["count"], F.lit(0)), i, e["name"].alias("name"))))
        return F.slice(F.transform(ranked, lambda e: e["name"]), 1, n)
    first = names(col(genres))
    return F.when(F.size(first) > 0, first).otherwise(names(col(tags)))


def vocal_verdict(transcript: Column | None = None, match_ratio: Column | None = None,
                  min_words: int = C.TRANSCRIPT_MIN_WORDS, confirm: float = C.CONFIRM_RATIO) -> Column:
    """True when a text is confirmed or a transcript has enough words, false for a short transcript."""
    out = F.when(F.lit(False), True)
    if match_ratio is not None:
        out = out.when(match_ratio >= confirm, True)
    if transcript is not None:
        words = F.size(F.filter(F.split(transcript, r"(?U)\s+"), lambda w: w != ""))
        out = out.when(transcript.isNotNull(), words >= min_words)
    return out
