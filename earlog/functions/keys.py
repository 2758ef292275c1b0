"""Musical keys on the mixing wheel."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from earlog.functions.columns import col, lookup

# --- fixed values: pitch spelling and its semitone --------------------------------------
PITCHES = {"C": 0, "C#": 1, "DB": 1, "D": 2, "D#": 3, "EB": 3, "E": 4, "F": 5, "F#": 6,
           "GB": 6, "G": 7, "G#": 8, "AB": 8, "A": 9, "A#": 10, "BB": 10, "B": 11}
RELATIONS = ["same", "energy-up", "energy-down", "relative"]   # in order of preference
# --- end of fixed values ----------------------------------------------------------------

_KEY = r"(?i)^([A-G](?:#|b)?)\s+(major|minor)$"


def parse_key(key: Column | str) -> Column:
    """struct(pitch 0..11, is_major); NULL for text that is no key."""
    text = F.trim(F.coalesce(col(key), F.lit("")))
    pitch = lookup(PITCHES, F.upper(F.regexp_extract(text, _KEY, 1)))
    major = F.lower(F.regexp_extract(text, _KEY, 2)) == "major"
    return F.when(pitch.isNotNull(), F.struct(pitch.alias("pitch"), major.alias("is_major")))


def wheel_number(pitch: Column, is_major: Column) -> Column:
    """The wheel is the circle of fifths: every semitone moves seven places."""
    return F.pmod(pitch * 7 + F.when(is_major, 7).otherwise(4), F.lit(12)) + 1


def wheel_code(key: Column | str) -> Column:
    """struct(num 1..12, letter A|B) of a key text, NULL if unparsable."""
    k = parse_key(key)
    return F.when(k.isNotNull(), F.struct(
        wheel_number(k["pitch"], k["is_major"]).cast("int").alias("num"),
        F.when(k["is_major"], "B").otherwise("A").alias("letter")))


def code_text(code: Column) -> Column:
    return F.concat(code["num"].cast("string"), code["letter"])


def compatible_codes(code: Column) -> Column:
    """The four codes that mix with `code`, each with its rank in RELATIONS."""
    num, letter = code["num"], code["letter"]
    other = F.when(letter == "B", "A").otherwise("B")

    def entry(rank, n, let):
        return F.struct(F.lit(rank).alias("rank"), n.cast("int").alias("num"), let.alias("letter"))

    return F.array(entry(0, num, letter),
                   entry(1, num % 12 + 1, letter),
                   entry(2, (num + 10) % 12 + 1, letter),
                   entry(3, num, other))


def key_relation(a: Column, b: Column) -> Column:
    """Relation of two wheel codes, NULL when they do not mix."""
    step = F.pmod(b["num"] - a["num"], F.lit(12))
    same_letter = a["letter"] == b["letter"]
    return (F.when((step == 0) & same_letter, "same").when(step == 0, "relative")
            .when((step == 1) & same_letter, "energy-up")
            .when((step == 11) & same_letter, "energy-down"))


def tempo_delta(cur: Column, other: Column, tolerance: float) -> Column:
    """Signed deviation from 1x, 2x or half tempo (first that fits); NULL when none does."""
    picks = []
    for factor in (1.0, 2.0, 0.5):
        d = (other / cur - factor) / factor
        picks.append(F.when(F.abs(d) <= tolerance, d))
    return F.when((cur > 0) & (other > 0), F.coalesce(*picks))
