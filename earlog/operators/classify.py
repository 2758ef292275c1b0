"""Is an item music? Title and channel rules, channel votes, details, and their cascade."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earlog.functions.columns import col, let
from earlog.functions.text import canonical_artist, strip

# --- fixed values: patterns, reasons and limits -----------------------------------------
STRONG = [
    (r"official\s+(music\s+)?(video|audio|visualizer)", "official"),
    (r"\boficial\b|\bvideoclip\b|\bmusic\s+video\b", "music-video"),
    (r"\blyrics?\b|\bтекст\s+песни\b", "lyrics"),
    (r"\bfeat\.?\b|\bft\.?\b|\bпри уч\.", "feat"),
    (r"\bremix\b|\bremaster", "remix"),
    (r"\binstrumental\b|\bcover\b|\bcover-version\b|\bкавер\b", "cover"),
    (r"\blive\s+(at|on|в)\b|\bconcert\b|\bконцерт", "live"),
    (r"\bаудио\b|\(audio\)|\[audio\]", "audio"),
    (r"^\s*\d{2}\s*[–—-]\s*", "numbered"),
    (r"\bnightcore\b|\bmashup\b|\bbootleg\b|\bmix\b", "edit"),
    (r"\b(full\s+)?album\b|\bmixtape\b", "album"),
]
NEGATIVE = (
    r"сезон|сериал|фильм|эпизод|episode|трейлер|trailer|teaser|обзор|review"
    r"|gameplay|геймплей|стрим|twitch|подкаст|podcast|интервью|interview"
    r"|пранк|prank|челлендж|challenge|реакци|reaction|смешные|прикол|смешно"
    r"|выпуск|эфир|news|новости|разбор|туториал|tutorial|как\s+сделать"
    r"|amv|gmв|аниме|anime\s+episode"
    r"|наушник|смартфон|айфон|iphone|android|unboxing|распаковк"
    r"|сравнени|ванплас|oneplus|xiaomi|redmi|samsung|honor\b|huawei"
    r"|ноутбук|видеокарт|процессор|монитор|умные\s+часы|smartwatch"
    r"|buds\b|airdots|колонк"
    r"|godot|unity|unreal|python|javascript|typescript|java\b|c\+\+"
    r"|программи|кодинг|coding|нейросет|chatgpt|gpt-|llm"
    r"|курс|лекци|урок|lesson|вебинар|gamedev|разработ"
    r"|vlog|влог|day\s+in\s+(my\s+)?life"
    r"|top\s*\d|лучшие\s+\w+|vs\b")
DASH = r"\s[–—-]\s"
SENTENCE_MARKS = "[?!:;…]"
WEAK_REASONS = ["artist-dash", "no-signal", "channel-music", "channel-not-music"]
REEVALUATED = WEAK_REASONS + ["anti-pattern", ""]
MUSIC_CATEGORY = 10
MAX_TRACK_SECONDS = 12 * 3600
MIN_VOTES, MUSIC_SHARE, NOT_MUSIC_SHARE = 3, 0.8, 0.2
MAX_ARTIST_WORDS = 5
# --- end of fixed values ----------------------------------------------------------------

_U = "(?U)"


def _dash_left(title: Column) -> Column:
    """Text before the first spaced dash, NULL without one."""
    parts = F.split(title, _U + DASH, 2)
    return F.when(F.size(parts) == 2, strip(parts[0]))


def is_artist_dash(title: Column | str) -> Column:
    """'Artist - Track': a short left side without sentence marks."""
    left = _dash_left(strip(F.coalesce(col(title), F.lit(""))))
    words = F.size(F.split(left, _U + r"\s+"))
    return F.coalesce((left != "") & (words <= MAX_ARTIST_WORDS) & ~left.rlike(SENTENCE_MARKS), F.lit(False))


def is_artist_channel_dash(title: Column | str, channel: Column | str) -> Column:
    """The left side of the dash is the channel itself, letter case aside."""
    left = _dash_left(strip(F.coalesce(col(title), F.lit(""))))
    ch = strip(F.coalesce(col(channel), F.lit("")))
    same = F.collate(left, "UNICODE_CI") == F.collate(ch, "UNICODE_CI")
    return F.coalesce((left != "") & (ch != "") & same, F.lit(False))


def rule_reason(title: Column | str = "title", channel: Column | str = "channel") -> Column:
    """Reason the title and channel give by themselves; '' when they give none.

    A negative title wins over everything; then channel evidence with one strong hit, then up to
    three strong hits, then the artist's own channel.
    """
    low = F.lower(strip(F.coalesce(col(title), F.lit(""))))
    ch = F.lower(F.coalesce(col(channel), F.lit("")))
    hits = F.filter(F.array(*[F.when(low.rlike(_U + p), F.lit(name)) for p, name in STRONG]), lambda h: h.isNotNull())
    owner = F.filter(F.array(F.when(ch.endswith("- topic"), F.lit("topic-channel")),
                             F.when(F.contains(ch, F.lit("vevo")), F.lit("vevo"))), lambda h: h.isNotNull())
    kept = let(F.struct(hits.alias("title"), owner.alias("channel")), lambda s: F.when(
        F.size(s["channel"]) > 0, F.concat(s["channel"], F.slice(s["title"], 1, 1))).otherwise(F.slice(s["title"], 1, 3)))
    positive = F.nullif(F.array_join(kept, "+"), F.lit(""))
    dash = (F.when(is_artist_channel_dash(title, channel), "artist-channel-dash")
            .when(is_artist_dash(title), "artist-dash").otherwise(""))
    return F.when(low.rlike(_U + NEGATIVE), "anti-pattern").otherwise(F.coalesce(positive, dash))


def reason_verdict(reason: Column) -> Column:
    """What a rule reason decides; NULL leaves the item open."""
    return F.when(reason == "anti-pattern", False).when(~reason.isin("", "artist-dash"), True)


def rules(title: Column | str = "title", channel: Column | str = "channel") -> Column:
    """struct(verdict, reason): NULL verdict means undecided."""
    return let(rule_reason(title, channel), lambda r: F.struct(reason_verdict(r).alias("verdict"), r.alias("reason")))


def channel_key(channel: Column | str = "channel") -> Column:
    return F.lower(strip(F.coalesce(col(channel), F.lit(""))))


def channel_votes(tracks: DataFrame) -> DataFrame:
    """Confident verdicts per channel: all items count, weak reasons do not."""
    sure = (F.col("is_music").isNotNull() & (F.coalesce("channel", F.lit("")) != "")
            & (F.coalesce("music_reason", F.lit("")) != "") & ~F.col("music_reason").isin(WEAK_REASONS))
    # conditional counts: a filter would be pushed down and repeat the rules behind these columns
    return tracks.groupBy(channel_key().alias("channel_key")).agg(
        F.count_if(sure).alias("n"), F.count_if(sure & F.col("is_music")).alias("n_music")).filter(F.col("n") > 0)


def vote_verdict(n: Column, n_music: Column) -> Column:
    share = n_music / n
    return F.when(n >= MIN_VOTES, F.when(share >= MUSIC_SHARE, True).when(share <= NOT_MUSIC_SHARE, False))


def details_verdict(found: Column, category: Column, duration: Column) -> Column:
    """struct(verdict, reason) from the details payload."""
    reason = (F.when(~found, "api-miss")
              .when(~category.eqNullSafe(F.lit(MUSIC_CATEGORY)), "api:not-music")
              .when(duration > MAX_TRACK_SECONDS, "api:too-long").otherwise("api:cat10"))
    return F.struct((reason == "api:cat10").alias("verdict"), reason.alias("reason"))


def classify(tracks: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Verdict and reason of every item after one run of the cascade.

    Undecided and weakly decided items go through rules, channel votes, then details (or
    'no-signal'). Votes are taken after the rules, over all items. The vote table has one row per
    channel, so the join moves no item rows when it is small enough to broadcast; a hot channel is
    one row there.
    """
    again = F.col("is_music").isNull() | F.coalesce("music_reason", F.lit("")).isin(REEVALUATED)
    rows = tracks.withColumn("_again", again).withColumn("_r", F.when(F.col("_again"), rule_reason()))
    rows = rows.withColumn("_rv", reason_verdict(F.col("_r")))
    decided = F.col("_rv").isNotNull()
    rows = rows.withColumns({
        "_open": F.col("_again") & ~decided,
        "is_music": F.when(decided, F.col("_rv")).otherwise(F.col("is_music")),
        "music_reason": F.when(decided, F.col("_r")).otherwise(F.col("music_reason"))})
    votes = channel_votes(rows)
    rows = rows.withColumn("channel_key", channel_key()).join(votes, "channel_key", "left")
    vote = F.when(F.col("_open"), vote_verdict(F.col("n"), F.col("n_music")))
    rows = rows.withColumn("_v", vote).withColumns({
        "is_music": F.coalesce("_v", "is_music"),
        "music_reason": F.when(F.col("_v").isNull(), F.col("music_reason"))
        .when(F.col("_v"), "channel-music").otherwise("channel-not-music"),
        "_open": F.col("_open") & F.col("_v").isNull()})
    rows = rows.drop("_v", "_r", "_rv", "_again", "channel_key", "n", "n_music")
    if details is None:
        return rows.withColumns({
            "is_music": F.when(F.col("_open"), False).otherwise(F.col("is_music")),
            "music_reason": F.when(F.col("_open"), "no-signal").otherwise(F.col("music_reason"))}).drop("_open")
    d = details.select("track_id", F.lit(True).alias("_found"), F.col("duration").alias("_duration"),
                       F.col("category_id").alias("_category"), F.col("channel").alias("_channel"))
    rows = rows.join(d, "track_id", "left")
    found = F.coalesce("_found", F.lit(False))
    verdict = details_verdict(found, F.col("_category"), F.col("_duration"))
    named = F.col("_open") & found & (F.coalesce("channel", F.lit("")) == "") & (F.coalesce("_channel", F.lit("")) != "")
    out = rows.withColumn("_d", F.when(F.col("_open"), verdict)).withColumns({
        "is_music": F.coalesce("_d.verdict", "is_music"), "music_reason": F.coalesce("_d.reason", "music_reason"),
        "duration": F.when(F.col("_open") & found, F.coalesce("_duration", "duration")).otherwise(F.col("duration")),
        "channel": F.when(named, F.col("_channel")).otherwise(F.col("channel"))})
    if "artist_canonical" in tracks.columns:
        out = out.withColumn("artist_canonical", F.when(named, canonical_artist("channel")).otherwise(F.col("artist_canonical")))
    if "category_id" in tracks.columns:
        out = out.withColumn("category_id", F.when(F.col("_open") & found, F.coalesce("_category", "category_id"))
                             .otherwise(F.col("category_id")))
    return out.drop("_d", "_open", "_found", "_duration", "_category", "_channel")
