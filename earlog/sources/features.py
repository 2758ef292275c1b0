"""Decoding of the feature table: JSON vectors, base64 half-float embeddings, JSON tags."""
from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from earlog import config as C
from earlog.functions.columns import col, let, rounded
from earlog.functions.ship import by_value

by_value(__name__)

VECTOR_COLS = ["mfcc", "chroma", "contrast"]
_TAG_SCHEMA = ("genres array<struct<name:string,score:double>>, styles map<string,double>, "
               "instruments array<struct<name:string,score:double>>, moods map<string,double>, "
               "moodtags map<string,double>, vocal_ratio double")


def parse_vector(text: Column | str) -> Column:
    """JSON array text to array<double>; NULL for empty or broken text."""
    return F.from_json(F.nullif(col(text), F.lit("")), "array<double>")


def decode_vectors(df: DataFrame, cols=tuple(VECTOR_COLS)) -> DataFrame:
    return df.withColumns({c: parse_vector(c) for c in cols})


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_half(text: pd.Series) -> pd.Series:
    """base64 of a half-float buffer to floats. Spark has no 16-bit float, hence Arrow batches."""
    def one(v):
        if not v:
            return None
        try:
            raw = base64.b64decode(v)
            return np.frombuffer(raw, dtype=np.float16).astype(np.float32)
        except ValueError:
            return None
    return text.map(one)


@F.pandas_udf(T.StringType())
def encode_half(values: pd.Series) -> pd.Series:
    """Inverse of `decode_half`, for writers."""
    return values.map(lambda v: None if v is None
                      else base64.b64encode(np.asarray(v, dtype=np.float16).tobytes()).decode("ascii"))


def _scores(entries: Column) -> Column:
    """Array of (name, score) to a map, later duplicates winning, a missing score being zero."""
    named = F.filter(entries, lambda g: g["name"].isNotNull())
    last = F.filter(named, lambda g, i: ~F.exists(
        F.slice(named, i + 2, F.size(named)), lambda h: h["name"] == g["name"]))
    return F.map_from_entries(F.transform(last, lambda g: F.struct(
        g["name"], F.coalesce(g["score"], F.lit(0.0)))))


def parse_tags(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Adds genres (top list), genre_vec, genre_list_vec, instrument_list, instrument_vec, moods,
    moodtags, tag_vocal. Empty or broken JSON gives empty containers.

    genre_vec prefers the style map, genre_list_vec is always the short list.
    """
    t = F.from_json(F.nullif(F.col(tags), F.lit("")), _TAG_SCHEMA)
    none = F.array().cast("array<struct<name:string,score:double>>")
    empty = F.create_map().cast("map<string,double>")
    out = df.withColumn("_t", t)
    genres, instruments = F.coalesce("_t.genres", none), F.coalesce("_t.instruments", none)
    styles = F.coalesce("_t.styles", empty)
    out = out.withColumns({
        "genres": genres, "instrument_list": instruments,
        "genre_list_vec": _scores(genres), "instrument_vec": _scores(instruments),
        "moods": F.coalesce("_t.moods", empty), "moodtags": F.coalesce("_t.moodtags", empty),
        "tag_vocal": F.coalesce("_t.vocal_ratio", F.lit(0.0))})
    return out.withColumn("genre_vec", F.when(F.size(styles) > 0, styles)
                          .otherwise(F.col("genre_list_vec"))).drop("_t")


def mood_columns(df: DataFrame) -> DataFrame:
    """The mood columns from the parsed tags: absent mood 0, no moods at all the uniform default."""
    names = F.array(*[F.lit(c) for c in C.MOOD_COLS])
    values = F.transform(names, lambda m: F.try_element_at("moods", m))

    def filled(found):
        some = F.exists(found, lambda v: v.isNotNull())
        return F.when(some, F.transform(found, lambda v: rounded(F.coalesce(v, F.lit(0.0)), 3)))

    out = df.withColumn("_m", let(values, filled))
    return out.withColumns({c: F.coalesce(F.get("_m", F.lit(i)), F.lit(C.MOOD_DEFAULT))
                            for i, c in enumerate(C.MOOD_COLS)}).drop("_m")


# --- fixed values: defaults of columns added to older feature tables --------------------
DEFAULTS = {"source": "audio", "tempo": 0.0, "energy": 0.0, "danceability": 0.0,
            "acousticness": 0.0, "brightness": 0.0, **{c: C.MOOD_DEFAULT for c in C.MOOD_COLS},
            "key": "", "mode_conf": 0.5, "mfcc": "", "chroma": "", "contrast": "", "tags": "",
            "embedding": "", "feat_version": 0}
NULLABLE = {"dynamics": "double", "loudness": "double", "percussive": "double",
            "vocal_ratio": "double", "has_vocals": "boolean"}
# --- end of fixed values ----------------------------------------------------------------


def align_schema(df: DataFrame) -> DataFrame:
    """Adds the feature columns an older table lacks; existing columns stay untouched."""
    have = set(df.columns)
    new = {c: F.lit(v) for c, v in DEFAULTS.items() if c not in have}
    new |= {c: F.lit(None).cast(t) for c, t in NULLABLE.items() if c not in have}
    return df.withColumns(new) if new else df
