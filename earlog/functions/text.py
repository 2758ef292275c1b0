"""Text expressions: artist names, titles, word counts."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from earlog.functions.columns import col, let

# --- fixed values: patterns -------------------------------------------------------------
ARTIST_SUFFIXES = [r"[-–—]\s*topic", r"[-–—]?\s*vevo", r"[-–—]\s*official\s+artist\s+channel",
                   r"[-–—]\s*official", r"\(\s*official\s*\)"]
TITLE_JUNK = (
    r"[(\[](official|lyrics?|lyric|audio|video|visualizer|remaster\w*|hd|hq|4k|mv"
    r"|explicit|clean|full version|version|premiere|премьера|официальн\w*"
    r"|live|session|studio|parody|пароди\w*|cover|кавер|remix|ремикс|radio edit"
    r"|outro|intro|bonus|re-?upload|reupload|full|tv anime|anime|amv"
    r"|[^)\]]*20\d{2}[^)\]]*)[^)\]]*[)\]]")
PIPE_TAIL = r"\s*[\|/]\s*(live|session|studio|from|official|version|edit|remix).*$"
TRACK_NUMBER = r"^\s*(track\s*)?\d{1,2}[\s.\-_]+\s*"
FANDOM = r"[【〖｢\[][^】〗｣\]]{0,50}[】〗｣\]]|\s+[×x]\s+.*$"
FEATURING = r"\s*[(\[]?\s*(feat\.?|ft\.?|featuring|при уч\.)\s.*$"
# --- end of fixed values ----------------------------------------------------------------

# every character that counts as white space at the ends of a text
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                            0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(c, F.lit(_SPACES))


def canonical_artist(channel: Column | str) -> Column:
    """Channel name without the usual trailing suffixes, spaces collapsed, dashes trimmed."""
    name = strip(F.coalesce(col(channel), F.lit("")))
    for suffix in ARTIST_SUFFIXES:
        name = F.regexp_replace(name, rf"(?iU){suffix}\s*$", "")
        name = F.regexp_replace(name, r"(?U)\s+$", "")
    name = F.regexp_replace(name, r"(?U)\s{2,}", " ")
    return strip(F.regexp_replace(name, "^[ \\-–—\\t]+|[ \\-–—\\t]+$", ""))


def artist_from_channel(channel: Column | str) -> Column:
    """Channel without ' - topic' and a trailing VEVO."""
    ch = strip(F.coalesce(col(channel), F.lit("")))
    ch = F.regexp_replace(ch, r"(?i) - topic$", "")
    ch = F.when(F.length(ch) > 4, F.regexp_replace(ch, r"(?i)vevo$", "")).otherwise(ch)
    return strip(ch)


def clean_title(title: Column | str) -> Column:
    """struct(artist, song) guessed from a decorated title."""
    t = F.coalesce(col(title), F.lit(""))
    t = F.regexp_replace(t, "(?iU)" + TITLE_JUNK, "")
    t = F.regexp_replace(t, "(?U)" + FANDOM, "")
    t = F.regexp_replace(t, "(?iU)" + PIPE_TAIL, "")
    t = F.regexp_replace(strip(F.regexp_replace(t, r"(?U)\s+", " ")), r"^[ \-|]+|[ \-|]+$", "")
    parts = F.split(t, " - ", 2)
    two = F.size(parts) == 2
    artist = F.when(two, strip(parts[0])).otherwise("")
    song = F.when(two, strip(F.try_element_at(parts, F.lit(2)))).otherwise(t)
    song = strip(F.regexp_replace(song, "(?iU)" + FEATURING, ""))
    song = strip(F.regexp_replace(song, "(?iU)" + TRACK_NUMBER, ""))
    artist = strip(F.regexp_replace(artist, "(?iU)" + FEATURING, ""))
    halves = F.split(song, "/", -1)
    first = strip(halves[0])
    song = F.when((F.size(halves) == 2) & F.length(first).between(3, 60), first).otherwise(song)
    return F.struct(artist.alias("artist"), song.alias("song"))


def plain(c: Column | str) -> Column:
    """Lower case without punctuation, letters of any script kept."""
    return strip(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)[^\w\s]+", ""))


def words_collapsed(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", " "))


def count_substrings(text: Column, stems: list[str]) -> Column:
    """Non-overlapping occurrences of each stem, summed over the stems."""
    def add(t: Column):
        return lambda acc, s: acc + ((F.length(t) - F.length(F.replace(t, s, F.lit("")))) / F.length(s)).cast("int")
    # the text is bound outside the loop over the stems
    return let(text, lambda t: F.aggregate(F.array(*[F.lit(s) for s in stems]), F.lit(0), add(t)))
