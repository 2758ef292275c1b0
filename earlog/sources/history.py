"""Play-history exports: scan and normalisation."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from earlog.functions.text import strip

HISTORY_SCHEMA = ("header string, title string, titleUrl string, "
                  "subtitles array<struct<name:string,url:string>>, time string")

# --- fixed values: how an export spells its records -------------------------------------
ITEM_ID = r"[?&]v=([\w-]{11})"
WATCHED = r"^(Просмотрено видео|Watched)\s*"
GONE = ("недоступна", "unavailable")
DEFAULT_HEADER = "YouTube"
MUSIC_HEADER = "YouTube Музыка"
# --- end of fixed values ----------------------------------------------------------------


def read_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of one or many export files, with file name and position.

    An export is one JSON array; files are read in parallel, and a file that is no array is
    refused. `lines=True` reads one record per line, which also splits inside a file.
    """
    reader = spark.read.schema(HISTORY_SCHEMA)
    if not lines:
        text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("no"),
                                            F.substring(F.ltrim("value"), 1, 1).alias("head"))
        heads = text.filter(F.col("head") != "").groupBy("file").agg(F.min_by("head", "no").alias("head"))
        if heads.filter(F.col("head") != "[").limit(1).count():
            raise ValueError("expected a JSON list of history entries")
        reader = reader.option("multiLine", True)
    return reader.json(path).withColumns({"file": F.col("_metadata.file_path"),
                                          "pos": F.monotonically_increasing_id()})


def normalize_history(records: DataFrame, tz: str = "UTC") -> DataFrame:
    """Usable plays: track_id, title, channel, header, listened_at (wall clock of `tz`), file, pos."""
    title = F.coalesce("title", F.lit(""))
    clean = strip(F.regexp_replace(title, "(?U)" + WATCHED, ""))
    instant = F.try_to_timestamp("time")
    wall = F.convert_timezone(F.current_timezone(), F.lit(tz), instant.cast("timestamp_ntz"))
    order = [c for c in ("file", "pos") if c in records.columns]
    gone = F.lit(False)
    for marker in GONE:
        gone = gone | F.contains(F.lower(clean), F.lit(marker))
    return records.filter(title.rlike("(?U)" + WATCHED)).select(
        F.regexp_extract(F.coalesce("titleUrl", F.lit("")), ITEM_ID, 1).alias("track_id"),
        clean.alias("title"), F.coalesce(F.get("subtitles", F.lit(0))["name"], F.lit("")).alias("channel"),
        F.coalesce(F.nullif("header", F.lit("")), F.lit(DEFAULT_HEADER)).alias("header"),
        wall.alias("listened_at"), gone.alias("_gone"), *order,
    ).filter((F.col("track_id") != "") & (F.col("title") != "") & ~F.col("_gone")
             & F.col("listened_at").isNotNull()).drop("_gone")
