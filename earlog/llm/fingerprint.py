"""Quartile bucket digest of whole texts: hashed byte triplets, two bits for each bucket, and the length."""
from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlog.llm.common import arrow_map

BUCKETS = 512
#: Bytes counted at once, so that a very long text needs no large arrays.
STEP = 1 << 20
#: Cost of a difference of 0, 1, 2 and 3 quartiles, and the most that lengths and quartile gaps add.
COSTS, LENGTH_MOST = (0, 1, 2, 6), 60


def bucket_counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How many of the byte triplets fall into each bucket."""
    total = np.zeros(buckets, np.int64)
    for at in range(0, max(0, len(data) - 2), STEP):
        a = np.frombuffer(data[at:at + STEP + 2], np.uint8).astype(np.uint32)
        h = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)
        total += np.bincount(h >> np.uint32(32 - int(math.log2(buckets))), minlength=buckets)
    return total


def digest(data: bytes, buckets: int = BUCKETS) -> str:
    """Hex: one byte for the length (eight steps for each doubling), then two bits for each bucket's quartile.

    Texts under three bytes have no triplet; every bucket is in the lowest quartile and the length tells them apart.
    """
    counts = bucket_counts(data, buckets)
    cuts = np.sort(counts)[[buckets // 4 - 1, buckets // 2 - 1, buckets * 3 // 4 - 1]]
    level = (counts > cuts[0]).astype(np.uint8) + (counts > cuts[1]) + (counts > cuts[2])
    four = level.reshape(-1, 4)
    size = min(255, round(8 * math.log2(1 + len(data))))
    return bytes([size]).hex() + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes().hex()


def levels(fp: str) -> np.ndarray:
    b = np.frombuffer(bytes.fromhex(fp), np.uint8)[1:]
    return np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3], 1).ravel()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the greatest difference: costs of quartile steps plus a bounded cost of the lengths."""
    x, y = levels(a).astype(np.int8), levels(b).astype(np.int8)
    cost = int(np.array(COSTS)[np.abs(x - y)].sum())
    cost += min(LENGTH_MOST, abs(int(a[:2], 16) - int(b[:2], 16)))
    return 1.0 - cost / (COSTS[3] * len(x) + LENGTH_MOST)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the digest of the whole text (null: empty). Row by row, without a shuffle; a clashing column is replaced."""
    rest = docs.drop(out)
    names = rest.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", `{out}` string"

    def add(batches):
        for c in batches:
            yield {n: c[n] for n in names} | {out: [digest((t or "").encode()) for t in c[text].to_pylist()]}
    return arrow_map(rest, add, schema)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, tail, doc_id, text) such that each document and the one after it are in one part, sorted together.

    Documents are ordered by doc_id (null first), then by a hash of the text, then by the text. Ranges of doc_id come from
    percentiles; the first document of a part is sent to the part before it as well, marked as tail. Whole texts are
    shuffled once; the driver sees one id for each part.
    """
    low = -2**63
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    edges = np.array(sorted(set(cuts)), np.int64)

    def part_of(ids):
        return np.searchsorted(edges, ids.fill_null(low).to_numpy(zero_copy_only=False), side="right").astype(np.int32)

    def place(batches):
        for c in batches:
            yield {"i": c["doc_id"].fill_null(low), "h": c["h"], "part": part_of(c["doc_id"])}
    # The first of each part: ids and hashes only. Rows that agree in both are the same document for this purpose.
    firsts = (arrow_map(rows.select("doc_id", "h"), place, "i bigint, h bigint, part int")
              .groupBy("part").agg(F.min(F.struct("i", "h")).alias("first")).orderBy("part").collect())
    before = {tuple(r["first"]): firsts[k - 1]["part"] for k, r in enumerate(firsts)}

    def spread(batches):
        for c in batches:
            yield c | {"part": part_of(c["doc_id"]), "tail": [False] * len(c["h"])}
            to = [before.get(k) for k in zip(c["doc_id"].fill_null(low).to_pylist(), c["h"].to_pylist())]
            again = [k for k, p in enumerate(to) if p is not None]
            if again:
                yield {n: c[n].take(again) for n in ("doc_id", "text", "h")} | {
                    "part": [to[k] for k in again], "tail": [True] * len(again)}
    out = arrow_map(rows, spread, "doc_id bigint, text string, h bigint, part int, tail boolean")
    return (out.repartition(max(1, parts // 4), "part")
            .sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "h", "text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's digest, that of an edited text, and its likeness to the edited text and to the next document.

    The edited text replaces the last quarter (rounded down, in code points) by as many first code points of the next
    document; the last document is followed by the first. A single document follows itself. Null texts count as empty;
    rows with a null id come first; repeated rows follow each other. Further columns are ignored.
    """
    parts = max(4, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pair(batches):
        def rows():
            for c in batches:
                yield from zip(c["part"].to_pylist(), c["tail"].to_pylist(), c["doc_id"].to_pylist(), c["text"].to_pylist())
        keys = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        out, held = {k: [] for k in keys}, None
        for part, tail, i, t in rows():
            fp = digest(t.encode())
            if held is not None and held[0] == part:
                _, di, dt, dfp = held
                cut = len(dt) // 4
                edited = (dt[:len(dt) - cut] + t[:cut]).encode()
                efp = digest(edited)
                for k, v in zip(keys, (di, len(dt), hashlib.sha256(edited).hexdigest(), dfp, efp, likeness(dfp, efp), likeness(dfp, fp))):
                    out[k].append(v)
            held = None if tail else (part, i, t, fp)
            if len(out["doc_id"]) >= 500:
                yield out
                out = {k: [] for k in keys}
        yield out
    return arrow_map(with_next(docs, parts), pair, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                     "edited_fingerprint string, near_edited double, near_next double")
