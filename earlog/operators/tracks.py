"""Catalogue search: filters, the paged track list, the full profile, manual overrides."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earlog import config as C
from earlog.functions.columns import artist, let, lookup, rounded
from earlog.operators import base

SORTS = ["play_count", "first_listen", "last_listen", "duration", "tempo", "energy",
         "danceability", "acousticness"]
_FEATURE_DIGITS = {"tempo": 1, "energy": 2, "danceability": 2, "acousticness": 2, "brightness": 2,
                   "loudness": 1, "dynamics": 2, "percussive": 2,
                   **{c: 3 for c in C.MOOD_COLS}, "vocal_ratio": 3}


# ---- predicates over the joined profile -------------------------------------------------
def filter_hidden(hidden: bool = False) -> Column:
    """Decided items only: NULL verdicts are in neither view."""
    return F.col("is_music") == F.lit(not hidden)


def filter_artist(name: str) -> Column:
    return artist() == name.strip()


def filter_search(q: str) -> Column:
    """Literal substring in title, channel or artist, ignoring case and accents.

    The collation does the folding inside the engine; no Python function per row.
    """
    term = F.collate(F.lit(q.strip()), "UNICODE_CI_AI")
    hit = F.lit(False)
    for c in ("title", "channel", "artist_canonical"):
        hit = hit | F.contains(F.collate(F.coalesce(c, F.lit("")), "UNICODE_CI_AI"), term)
    return hit


def filter_cluster(cluster_id: int) -> Column:
    return F.col("cluster_id") == cluster_id


def filter_genre(name: str) -> Column:
    return F.exists("genres", lambda g: g["name"] == name)


def filter_key(key: str) -> Column:
    return F.col("key") == key.strip()


def filter_instrumental(min_vocal: float = C.VOCAL_RATIO_MIN) -> Column:
    """Only a transcript, or no text row at all and no voice as far as known."""
    no_voice = (F.col("has_vocals") == F.lit(False)) | (
        F.col("has_vocals").isNull() & (F.col("vocal_ratio") < min_vocal))
    return (F.col("text_source") == "whisper") | (F.col("text_source").isNull() & no_voice)


def filter_language(code: str) -> Column:
    return (F.col("language") == code) & (F.col("text_source") != "whisper")


def dominant_moods(features: DataFrame) -> DataFrame:
    """track_id, mood: the moods that are largest after dividing each by its maximum; ties give rows.

    The eleven maxima are one aggregate, read back as a scalar subquery: no join, no shuffle of
    rows. The generator also keeps filters on `mood` from repeating the arithmetic below it.
    """
    audio = features.filter(F.col("source") == "audio")
    values = F.array(*[F.coalesce(c, F.lit(0.0)) for c in C.MOOD_COLS])
    peaks = F.array(*[F.max(F.coalesce(c, F.lit(0.0))) for c in C.MOOD_COLS])
    peak = audio.agg(F.transform(peaks, lambda m: F.when(m == 0, 1.0).otherwise(m)).alias("peak")).scalar()
    names = F.array(*[F.lit(m) for m in C.MOODS])

    def largest(scaled: Column) -> Column:
        hits = F.transform(scaled, lambda v, i: F.when(v >= F.array_max(scaled), F.get(names, i)))
        return F.filter(hits, lambda m: m.isNotNull())

    scaled = F.zip_with("_v", "_p", lambda v, p: v / p)
    rows = audio.select("track_id", values.alias("_v")).withColumn("_p", peak)
    return rows.select("track_id", F.explode_outer(let(scaled, largest)).alias("mood"))


def mood_tracks(features: DataFrame, mood: str) -> DataFrame:
    """Items whose dominant mood is `mood`; ties count."""
    mood = mood.strip().lower()
    if mood not in C.MOODS:
        raise ValueError(f"unknown mood: {mood}")
    return dominant_moods(features).filter(F.col("mood") == mood).select("track_id")


# ---- joined relations ---------------------------------------------------------------------
def play_range(listens: DataFrame) -> DataFrame:
    return base.play_counts(listens).select("track_id", F.col("first_at").alias("first_listen"),
                                            F.col("last_at").alias("last_listen"))


def join_profile(tracks: DataFrame, listens: DataFrame, features: DataFrame, lyrics: DataFrame) -> DataFrame:
    """Catalogue with play range, features and text facts, all outer-joined on the item.

    Plays are reduced to one row per item first, so the widest join input is the catalogue.
    """
    if "cluster_id" not in tracks.columns:
        tracks = tracks.withColumn("cluster_id", F.lit(None).cast("int"))
    keep = ["track_id", "source", "key", "mode_conf", "has_vocals", "tags", "genres", "instrument_list",
            "analyzed_at", *_FEATURE_DIGITS]
    feats = features.select(*[c for c in keep if c in features.columns]).withColumnRenamed(
        "source", "features_source")
    text_cols = [c for c in ("sentiment", "topics") if c in lyrics.columns]
    texts = lyrics.select("track_id", "language", F.col("source").alias("text_source"),
                          (F.col("text") != "").alias("_text"), *text_cols)
    return (tracks.join(play_range(listens), "track_id", "left").join(feats, "track_id", "left")
            .join(texts, "track_id", "left"))


def conditions(q="", artist_name="", cluster_id=None, hidden=False, genre="", language="", key="",
               instrumental=False) -> Column:
    cond = filter_hidden(hidden)
    if artist_name.strip():
        cond = cond & filter_artist(artist_name)
    if q.strip():
        cond = cond & filter_search(q)
    if cluster_id is not None:
        cond = cond & filter_cluster(cluster_id)
    if genre:
        cond = cond & filter_genre(genre)
    if key.strip():
        cond = cond & filter_key(key)
    if language:
        cond = cond & filter_language(language)
    if instrumental:
        cond = cond & filter_instrumental()
    return cond


def select_tracks(tracks, listens, features, lyrics, errors: DataFrame | None = None, mood: str = "",
                  only_errors: bool = False, **filters) -> DataFrame:
    """All rows matching the filters, before sorting and paging."""
    rows = join_profile(tracks, listens, features, lyrics).filter(conditions(**filters))
    if mood:
        rows = base.semi(rows, mood_tracks(features, mood))
    if only_errors:
        rows = base.semi(rows, errors.select("track_id"))
    return rows


def order_cols(sort: str = "play_count", order: str = "desc") -> list[Column]:
    """NULLs first ascending and last descending; then title and id."""
    sort = sort if sort in SORTS else "play_count"
    main = F.col(sort).asc_nulls_first() if order == "asc" else F.col(sort).desc_nulls_last()
    return [main, F.col("title").asc(), F.col("track_id").asc()]


def page(df: DataFrame, sort="play_count", order="desc", page_no: int = 1, per_page: int = 200) -> DataFrame:
    """One page with the total; only the page is sorted out of the data (take-ordered)."""
    size = max(1, per_page)
    first = (max(1, page_no) - 1) * size
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order_cols(sort, order)).offset(first).limit(size)
    # one page of rows is left here, so numbering them in one task is bounded
    return rows.withColumns({"total": total,
                             "position": F.row_number().over(Window.orderBy(*order_cols(sort, order))) + first})


def after(sort: str, order: str, value, title, track_id) -> Column:
    """Rows behind a row in the list's order: its sort value, title and id as plain comparisons, which filters can push down."""
    sort = sort if sort in SORTS else "play_count"
    this = F.col(sort)

    def past(c: Column, v) -> Column:
        return c.isNotNull() if v is None else c > F.lit(v)
    if order == "asc":                     # NULLs first
        beyond = past(this, value)
    else:                                  # NULLs last
        beyond = F.lit(False) if value is None else (this < F.lit(value)) | this.isNull()
    same = this.isNull() if value is None else this == F.lit(value)
    same_title = F.col("title").isNull() if title is None else F.col("title") == F.lit(title)
    return beyond | (same & (past(F.col("title"), title) | (same_title & (F.col("track_id") > F.lit(track_id)))))


def page_after(df: DataFrame, last: tuple | None, sort="play_count", order="desc", per_page: int = 200) -> DataFrame:
    """The page that follows the row `last` (sort value, title, id; None: the first page), with the total of all rows.

    Nothing is skipped over: rows before the page are filtered out where they are read, however deep the page lies.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df if last is None else df.filter(after(sort, order, *last))
    return rows.orderBy(*order_cols(sort, order)).limit(max(1, per_page)).withColumn("total", total)


def display(df: DataFrame, clusters: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Rounded display columns; run on a page, after the limit."""
    out = df
    if clusters is not None:
        out = out.join(clusters.select("cluster_id", F.col("name").alias("cluster_name")), "cluster_id", "left")
    else:
        out = out.withColumn("cluster_name", F.lit(""))
    if errors is not None:
        flag = errors.select("track_id").distinct().withColumn("_err", F.lit(True))
        out = out.join(flag, "track_id", "left")
    else:
        out = out.withColumn("_err", F.lit(None).cast("boolean"))
    return out.select(
        "track_id", "title", "channel", artist().alias("artist"), "play_count", "duration", "cluster_id",
        F.coalesce("cluster_name", F.lit("")).alias("cluster_name"),
        F.date_format("first_listen", "yyyy-MM-dd").alias("first_listen"),
        F.date_format("last_listen", "yyyy-MM-dd").alias("last_listen"),
        "music_reason", F.coalesce("language", F.lit("")).alias("language"),
        *[c for c in ("sentiment",) if c in df.columns],
        *[rounded(c, d).alias(c) for c, d in _FEATURE_DIGITS.items() if c in df.columns],
        "key", "features_source", "has_vocals",
        F.transform("genres", lambda g: g["name"]).alias("genres"),
        F.transform("instrument_list", lambda g: g["name"]).alias("instruments"),
        F.coalesce("_err", F.lit(False)).alias("has_error"),
        *[c for c in ("total", "position") if c in df.columns])


def tracks_query(tracks, listens, features, lyrics, clusters=None, errors=None, sort="play_count",
                 order="desc", page_no=1, per_page=200, **filters) -> DataFrame:
    rows = select_tracks(tracks, listens, features, lyrics, errors, **filters)
    return display(page(rows, sort, order, page_no, per_page), clusters, errors).orderBy("position")


def tracks_page_after(tracks, listens, features, lyrics, last: tuple | None, clusters=None, errors=None, sort="play_count",
                      order="desc", per_page=200, **filters) -> DataFrame:
    rows = select_tracks(tracks, listens, features, lyrics, errors, **filters)
    return display(page_after(rows, last, sort, order, per_page), clusters, errors).orderBy(*order_cols(sort, order))


def dominant_topic(topics: Column | str = "topics", order: list[str] | None = None) -> Column:
    """Topic with the largest weight, the earlier one on a tie; '' without topics."""
    topics = F.col(topics) if isinstance(topics, str) else topics
    entries = F.map_entries(topics)
    if order:
        rank = lambda e: -F.coalesce(lookup({t: i for i, t in enumerate(order)}, e["key"]),
                                     F.lit(len(order)))
    else:
        rank = lambda e: -F.array_position(F.map_keys(topics), e["key"])                      # noqa: E731
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["value"], rank(e), e["key"].alias("name"))))
    return F.coalesce(best["name"], F.lit(""))


def track_profile(tracks, listens, features, lyrics, clusters=None, errors=None) -> DataFrame:
    """Everything known about each item; one item is a filter, which reaches all the scans."""
    rows = join_profile(tracks, listens, features, lyrics)
    out = display(rows, clusters, errors).join(
        rows.select("track_id", F.coalesce("_text", F.lit(False)).alias("has_lyrics"),
                    (dominant_topic() if "topics" in rows.columns else F.lit("")).alias("topic"),
                    F.col("genres").alias("genre_scores"),
                    F.col("instrument_list").alias("instrument_scores")), "track_id")
    if errors is not None:
        lists = errors.groupBy("track_id").agg(F.sort_array(F.collect_list(
            F.struct("created_at", "stage", "error")), False).alias("errors"))
        out = out.join(lists, "track_id", "left")
    return out


def apply_overrides(tracks: DataFrame, items: DataFrame | None = None,
                    hidden_channels: DataFrame | None = None) -> DataFrame:
    """Manual verdicts: single items (track_id, is_music), then channels to hide."""
    out = tracks
    if items is not None:
        last = items.select("track_id", F.col("is_music").alias("_set"))
        out = out.join(last, "track_id", "left").withColumns({
            "is_music": F.coalesce("_set", "is_music"),
            "music_reason": F.when(F.col("_set").isNotNull(), "manual").otherwise(F.col("music_reason"))
        }).drop("_set")
    if hidden_channels is not None:
        names = hidden_channels.select(F.trim("channel").alias("channel")).filter(
            F.col("channel") != "").distinct().withColumn("_hide", F.lit(True))
        hide = F.coalesce("_hide", F.lit(False)) & F.coalesce("is_music", F.lit(False))
        out = (out.join(names, "channel", "left").withColumn("_hide", hide)
               .withColumns({"is_music": F.when(F.col("_hide"), False).otherwise(F.col("is_music")),
                             "music_reason": F.when(F.col("_hide"), "manual-not-music")
                             .otherwise(F.col("music_reason"))}).drop("_hide"))
    return out


def hidden_count(tracks: DataFrame, hidden_channels: DataFrame) -> DataFrame:
    """How many music items each channel to hide would lose."""
    names = hidden_channels.select(F.trim("channel").alias("channel")).distinct()
    return (tracks.filter("is_music").groupBy("channel").agg(F.count(F.lit(1)).alias("hidden"))
            .join(names, "channel"))
