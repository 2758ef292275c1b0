"""Quality rules: word statistics, then bands of zstandard ratios over the whole text and over fixed chunks.

Repetitive text compresses far below prose of its length, encoded or random text hardly at all. What is usual depends on the
length (a short frame has little to refer back to), so every length has its own limits. A text is rejected when its whole
ratio lies outside its band, or when chunks outside theirs hold more than a share of its bytes: a long clean text with a
dump in the middle has a usual whole ratio and unusual chunks.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from earlog.llm.common import arrow_map

#: Longest text in bytes, least and greatest ratio of compressed to raw bytes. Up to 64 bytes a frame says nothing.
LIMITS = ((64, 0.0, float("inf")), (256, .30, .95), (512, .28, .85), (1024, .25, .78), (2048, .22, .72), (4096, .20, .68),
          (16384, .18, .64), (None, .15, .62))
CHUNK_BYTES, MOST_BAD, LEVEL = 4096, 0.25, 3
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bytes whose words are held as objects at once.
STEP = 1 << 20
SYMBOLS = b"#*$%&|<>"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

OUT = T.StructType([T.StructField(n, t) for n, t in (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("zstd_ratio", T.DoubleType()), ("n_chunks", T.LongType()),
    ("n_bad_chunks", T.LongType()), ("bad_bytes", T.LongType()), ("kept", T.BooleanType()))])


def word_ids(data: bytes) -> np.ndarray:
    """Words in order, equal words with equal numbers from 0; a text is cut at blanks, so few words are objects at once."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(data):
        cut = _BLANK.search(data, at + STEP) if len(data) - at > STEP else None
        end = cut.start() if cut else len(data)
        words = data[at:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside a three-word window that the text has twice or more, its first place included."""
    if len(ids) < 4:
        return 0
    size = int(ids.max()) + 1
    pair = ids[:-2] * size + ids[1:-1]
    if size > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, times = np.unique(pair * size + ids[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k:len(ids) - 2 + k] |= twice
    return int(inside.sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            n += 1
        elif line and not line.isspace():
            seen.add(line)
    return n


class Bands:
    """Ratios of a text and of its chunks against the limits of their lengths."""

    def __init__(self, limits=LIMITS, chunk_bytes: int = CHUNK_BYTES, most_bad: float = MOST_BAD, level: int = LEVEL):
        import zstandard
        self.limits, self.chunk_bytes, self.most_bad = limits, chunk_bytes, most_bad
        self.ends = [end for end, _, _ in limits[:-1]]
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)

    def ratio(self, data: bytes) -> float:
        """Compressed to raw bytes; the compressed text is counted, not kept."""
        if not data:
            return 0.0
        if len(data) <= STEP:
            return len(self.pack.compress(data)) / len(data)
        size, stream = 0, self.pack.compressobj(size=len(data))
        for at in range(0, len(data), STEP):
            size += len(stream.compress(data[at:at + STEP]))
        return (size + len(stream.flush())) / len(data)

    def usual(self, data: bytes, ratio: float) -> bool:
        _, low, high = self.limits[bisect_left(self.ends, len(data))]
        return low <= ratio <= high

    def judge(self, data: bytes) -> tuple[float, int, int, int, bool]:
        """Whole ratio, chunks, chunks outside their band, bytes of those, verdict."""
        whole = self.ratio(data)
        n = bad = lost = 0
        for at in range(0, len(data), self.chunk_bytes):
            piece = data[at:at + self.chunk_bytes]
            n += 1
            if not self.usual(piece, whole if len(piece) == len(data) else self.ratio(piece)):
                bad += 1
                lost += len(piece)
        return whole, n, bad, lost, self.usual(data, whole) and lost <= self.most_bad * len(data)


def judge(data: bytes, bands: Bands) -> dict:
    ids = word_ids(data)
    flat = np.frombuffer(data, np.uint8)
    blank = int((flat == 0x20).sum() + ((flat >= 9) & (flat <= 13)).sum())
    repeated = repeated_words(ids)
    failed = len(ids) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(ids)
    whole, n, bad, lost, fine = bands.judge(data)
    return {"n_words": len(ids), "word_chars": int(((flat & 0xC0) != 0x80).sum()) - blank,
            "n_symbols": sum(data.count(SYMBOLS[k:k + 1]) for k in range(len(SYMBOLS))), "n_dup_lines": repeated_lines(data),
            "n_repeat_words": repeated, "base_failed": failed, "zstd_ratio": whole, "n_chunks": n, "n_bad_chunks": bad,
            "bad_bytes": lost, "kept": fine and not failed}


def quality_rules(df: DataFrame, text: str = "text", limits=LIMITS, chunk_bytes: int = CHUNK_BYTES, most_bad: float = MOST_BAD,
                  level: int = LEVEL) -> DataFrame:
    """Adds the columns of `OUT` to every row; row by row, no shuffle.

    Words are `[^\\x20\\x09-\\x0D]+`. A null text counts as an empty one: no words, so `base_failed`, not kept, ratio 0.
    Every row is judged alone, so ties, repeated rows and an empty table need no rule. Input columns with a name of `OUT`
    are replaced. Memory of a row is a small multiple of its text: words are numbered in steps, compressed bytes are counted
    as they come.
    """
    own = OUT.fieldNames()
    rest = T.StructType([f for f in df.schema if f.name not in own])
    carried = [f.name for f in rest]
    own_text = "_text"
    while own_text in carried:
        own_text += "_"

    def run(batches) -> Iterator[dict]:
        bands = Bands(limits, chunk_bytes, most_bad, level)
        for c in batches:
            found = [judge(v.as_buffer().to_pybytes() if v.is_valid else b"", bands) for v in c[own_text]]
            yield {n: c[n] for n in carried} | {n: [f[n] for f in found] for n in own}

    quoted = [f"`{n.replace('`', '``')}`" for n in carried]
    texts = f"`{text.replace('`', '``')}` AS {own_text}"
    return arrow_map(df.selectExpr(*quoted, texts), run, T.StructType([*rest, *OUT]))
