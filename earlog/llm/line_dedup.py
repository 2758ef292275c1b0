"""Repeated runs of lines: a suffix array over line numbers by distributed prefix doubling; later copies are deleted.

Every line of every text is a position. Ranks order the suffixes by their first 2**k lines; a doubling step ranks pairs of
ranks 2**k lines apart. Suffixes that are alone in their rank drop out: what starts there is not repeated. A run of L lines is
an interval of the suffix array whose members agree on L lines, named by two overlapping ranks of 2**k <= L < 2**(k+1) lines.
A run counts if it has at least `min_words` words; it is enough to look at the shortest such runs from every start and to every
end, as they cover every longer run. All but the first copy of a run (by document, then line) are deleted.
"""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from earlog.llm.common import arrow_map, spare, stash

#: Words that a repeated run must have before its later copies go.
MIN_WORDS = 30
LAST = 2**63 - 1


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every line the number of lines of the shortest run with `least` words that starts, and that ends, there; 0: none."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ahead = np.searchsorted(total, total[:-1] + least, side="left")
    back = np.searchsorted(total, total[1:] - least, side="right") - 1
    return np.where(ahead <= n, np.maximum(1, ahead - np.arange(n)), 0), np.where(total[1:] >= least, np.maximum(1, np.arange(1, n + 1) - back), 0)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, pos): lines of later copies. d is doc_id (null: after all others), h the hash of the text, pos counts from 0."""
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))

    def lines(batches):
        names = ("d", "h", "pos", "line", "ahead", "back")
        for c in batches:
            out = {n: [] for n in names}
            for d, h, t in zip(c["d"].to_pylist(), c["h"].to_pylist(), c["text"].to_pylist()):
                ls = t.split("\n")
                ahead, back = shortest_runs(np.array([len(x.split()) for x in ls]), min_words)
                for n, v in zip(names, ([d] * len(ls), [h] * len(ls), range(len(ls)), map(line_hash, ls), ahead.tolist(), back.tolist())):
                    out[n].extend(v)
                if len(out["d"]) > 20_000:
                    yield out
                    out = {n: [] for n in names}
            yield out
    # Rows that agree in id and text are one document.
    hashed = rows.withColumn("h", F.xxhash64("text"))
    every = stash(arrow_map(hashed, lines, "d bigint, h bigint, pos int, line bigint, ahead int, back int"))
    often = stash(every.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"))
    seq = stash(every.join(often, "line").groupBy("d", "h", "pos").agg(F.first("line").alias("line"), F.first("ahead").alias("ahead"),
                                                                      F.first("back").alias("back")))
    runs = stash(seq.select("d", "h", F.explode(F.array(
        F.struct(F.col("pos").alias("start"), F.col("ahead").alias("len")),
        F.struct((F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("len")))).alias("r"))
        .select("d", "h", "r.start", "r.len").where("len > 0").distinct())
    longest = runs.agg(F.max("len")).first()[0] or 0

    # k = 0: the order of line hashes is the order of the alphabet.
    ranks, width, later = seq.select("d", "h", "pos", F.col("line").alias("rank")), 1, None
    while width <= longest:
        # Runs of this level: both overlapping blocks must be there, so all lines of the run are repeated ones.
        here = runs.where(F.col("len").between(width, 2 * width - 1))
        first = ranks.withColumnsRenamed({"pos": "start", "rank": "ra"})
        named = here.join(first, ["d", "h", "start"])
        if width > 1:
            second = ranks.select("d", "h", F.col("pos").alias("tail"), F.col("rank").alias("rb"))
            named = named.withColumn("tail", F.col("start") + F.col("len") - width).join(second, ["d", "h", "tail"])
        else:
            named = named.withColumn("rb", F.col("ra"))
        named = stash(named.select("d", "h", "start", "len", "ra", "rb"))
        groups = stash(named.groupBy("len", "ra", "rb").agg(F.min(F.struct("d", "h", "start")).alias("f"), F.count("*").alias("n"))
                       .where("n > 1").select("len", "ra", "rb", "f"))
        copies = (named.join(groups, ["len", "ra", "rb"]).where(F.struct("d", "h", "start") != F.col("f"))
                  .select("d", "h", "start", "len"))
        later = copies if later is None else later.union(copies)
        if 2 * width > longest:
            break
        # Doubling: pairs of ranks, ordered; a row number over the sorted distinct pairs is the new rank.
        ahead = ranks.select("d", "h", (F.col("pos") - width).alias("pos"), F.col("rank").alias("second"))
        pairs = stash(ranks.join(ahead, ["d", "h", "pos"]))
        order = stash(pairs.groupBy("rank", "second").agg(F.count("*").alias("n")).where("n > 1").orderBy("rank", "second")
                      .select("rank", "second", F.monotonically_increasing_id().alias("new")))
        ranks = stash(pairs.join(order, ["rank", "second"]).select("d", "h", "pos", F.col("new").alias("rank")))
        width *= 2
        if ranks.isEmpty():
            break
    if later is None:
        return seq.select("d", "h", "pos").limit(0)
    return (later.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))
            .select("d", "h", "pos").distinct())


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the later copies of repeated line runs: all columns, the shorter text, and deleted_lines.

    Documents are ordered by doc_id (null last), then by the hash of the text. Texts without deletions stay byte for byte; a
    document that loses all its lines has the text '' and deleted_lines equal to its lines. Null and empty texts have no run
    and stay. Rows that agree in id and text are one document and share its deletions. n_chars, where present, follows; other
    columns, whatever their names, are carried as they are.
    """
    d, h, g, k, t = spare(docs.columns, "_d", "_h", "_gone", "_k", "_t")
    gone = (repeated_lines(docs.select("doc_id", "text"), min_words).groupBy(F.col("d").alias(d), F.col("h").alias(h))
            .agg(F.array_sort(F.collect_list("pos")).alias(g)))                  # positions of one document only
    keyed = docs.drop("deleted_lines").withColumns({k: F.coalesce("doc_id", F.lit(LAST)), t: F.xxhash64(F.coalesce("text", F.lit("")))})
    joined = keyed.join(gone, (F.col(k) == F.col(d)) & (F.col(t) == F.col(h)), "left").drop(d, h, k, t)
    names = [c for c in joined.columns if c not in (g, "text")]
    schema = StructType([f for f in joined.schema if f.name != g]).add("deleted_lines", IntegerType())

    def cut(batches):
        for c in batches:
            texts, n = [], []
            for text, lines in zip(c["text"].to_pylist(), c[g].to_pylist()):
                if lines:
                    lost = set(lines)
                    text = "\n".join(x for j, x in enumerate(text.split("\n")) if j not in lost)
                texts.append(text)
                n.append(len(lines or ()))
            yield {x: c[x] for x in names} | {"text": texts, "deleted_lines": n}
    out = arrow_map(joined, cut, schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("deleted_lines") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out
