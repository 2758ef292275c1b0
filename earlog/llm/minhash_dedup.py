"""Near-duplicate texts: banded MinHash, sequential Bayesian pruning of candidates, exact verification, components.

Work is kept linear in groups of copies. Texts with the same set of shingles form a class and only one of a class is banded.
First every member of a band bucket meets only the next one in the bucket's order (four orders over the bands); the links
confirmed so far give components. Then only buckets that still hold several components are searched in full, in blocks, for
pairs of different components; full sets travel with these rows, so a task confirms survivors itself and returns links alone.
Every pair that shares a bucket is thus confirmed, pruned by its posterior, or needless because both are already connected.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlog.llm.common import arrow_map, components, stash

#: Chance that no band of a pair at the threshold agrees; posterior below which a candidate is pruned.
MISS, PRUNE = 1e-6, 1e-6
MOST_HASHES, BATCH, BLOCK = 192, 16, 512
#: Shingles that are hashed at once.
STEP = 4096
U = np.uint64


def bands_for(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Rows of a band and number of bands: the longest bands whose number reaches the miss chance."""
    fits = [(r, b) for r in range(1, 17)
            if r * (b := math.ceil(math.log(miss) / math.log1p(-min(threshold ** r, 1 - 1e-12)))) <= MOST_HASHES]
    return fits[-1]


def least_matches(threshold: float, hashes: int, prune: float = PRUNE) -> np.ndarray:
    """For m = 0..hashes compared: the fewest matches at which P(similarity >= threshold) is not below `prune`.

    With a uniform prior the posterior is Beta(s + 1, m - s + 1), whose tail is a binomial sum.
    """
    out = np.zeros(hashes + 1, np.int64)
    for m in range(1, hashes + 1):
        total = 0.0
        for s in range(m + 1):
            total += math.comb(m + 1, s) * threshold ** s * (1 - threshold) ** (m + 1 - s)
            if total >= prune:
                out[m] = s
                break
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(30)) * U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> U(27)) * U(0x94D049BB133111EB)
    return h ^ h >> U(31)


class Shingler:
    """Distinct 64-bit hashes of the word shingles of a text; A-Z lowered, words parted by ASCII white space."""

    MOST = 1_000_000

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def shingles(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode().lower().split()
        if not ws:
            return np.empty(0, U)
        if len(self.known) > self.MOST:
            self.known.clear()
        known = self.known
        for w in (w for w in set(ws) if w not in known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.array([known[w] for w in ws], U)
        n = min(self.words, len(h))
        out = np.zeros(len(h) - n + 1, U)
        for j in range(n):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[j:len(h) - n + 1 + j] + U(j + 1))
        return np.unique(out)


def set_key(shingles: bytes) -> str | None:
    return hashlib.blake2b(shingles, digest_size=16).hexdigest() if shingles else None


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value under each of the hash functions, over all shingles."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    low = (s & U(0xFFFFFFFF)).astype(np.uint32) ^ (s >> U(32)).astype(np.uint32)
    for k in range(0, len(low), STEP):
        v = low[k:k + STEP, None] * a[None] + b[None]
        np.minimum(out, (v ^ v >> np.uint32(15)).min(0), out=out)
    return out


def survives(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of two aligned signature arrays pass all batches: those below the bound go, the rest is compared further."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k in range(0, x.shape[1], BATCH):
        matches += (x[alive, k:k + BATCH] == y[alive, k:k + BATCH]).sum(1)
        ok = matches >= least[min(k + BATCH, x.shape[1])]
        alive, matches = alive[ok], matches[ok]
        if not len(alive):
            break
    return alive


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """Bucket of each signature in each band."""
    x = sig.reshape(len(sig), bands, -1)
    h = np.zeros(x.shape[:2], U) + np.arange(1, bands + 1, dtype=U)[None]
    for j in range(x.shape[2]):
        h = mix(h * U(0x9E3779B97F4A7C15) + x[:, :, j])
    return h.view(np.int64)


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def full_sets(wanted: DataFrame, docs: DataFrame, sigs: DataFrame, words: int) -> DataFrame:
    """Written table (rep, sig, s): signature and full shingle set of the wanted documents, from their whole texts."""
    def sets(batches):
        s = Shingler(words)
        for c in batches:
            found = [s.shingles(t).tobytes() for t in c["text"].to_pylist()]
            # A repeated id may carry several texts: the one of the class counts.
            keep = [k for k, (x, key) in enumerate(zip(found, c["key"].to_pylist())) if set_key(x) == key]
            yield {n: c[n].take(pa.array(keep, pa.int64())) for n in ("rep", "key", "sig")} | {"s": [found[k] for k in keep]}
    own = wanted.join(sigs, "rep")
    return stash(arrow_map(docs.join(own, docs["doc_id"] == own["rep"]).select("rep", "key", "sig", "text"), sets,
                           "rep bigint, key string, sig binary, s binary").dropDuplicates(["rep", "key"]).select("rep", "sig", "s"))


def verified(pairs: DataFrame, full: DataFrame, threshold: float, least: np.ndarray) -> DataFrame:
    """Pairs (a, b) whose signatures survive and whose full shingle sets reach the threshold."""
    percent = round(threshold * 100)

    def both(rows: DataFrame, c: str) -> DataFrame:
        return (rows.join(full.select(F.col("rep").alias("a"), F.col(c).alias("x")), "a")
                .join(full.select(F.col("rep").alias("b"), F.col(c).alias("y")), "b"))

    def prune(batches):
        for c in batches:
            x, y = (np.frombuffer(b"".join(c[n].to_pylist()), np.uint32).reshape(len(c["a"]), -1) for n in "xy")
            keep = survives(x, y, least)
            yield {n: c[n].take(keep) for n in "ab"}

    def confirm(batches):
        for c in batches:
            keep = [k for k, (p, q) in enumerate(zip(c["x"].to_pylist(), c["y"].to_pylist()))
                    if similar(np.frombuffer(p, U), np.frombuffer(q, U), percent)]
            yield {n: c[n].take(pa.array(keep, pa.int64())) for n in "ab"}
    left = stash(arrow_map(both(pairs, "sig"), prune, "a bigint, b bigint"))
    return arrow_map(both(left, "s"), confirm, "a bigint, b bigint")


def minhash_components(docs: DataFrame, words: int = 5, threshold: float = 0.8, miss: float = MISS, prune: float = PRUNE,
                       block: int = BLOCK, seed: int = 3) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts with fewer words than a shingle have one shingle, the whole sequence; null and blank texts have none and link with
    nothing. Rows without an id link with nothing, have no component and stay. Rows that repeat an id are one node, and all
    of them are kept or not together. Texts with equal sets are linked. Further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows_, bands = bands_for(threshold, miss)
    hashes = rows_ * bands
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 2**32, hashes, dtype=np.uint32) for _ in "ab")
    a |= np.uint32(1)
    least = least_matches(threshold, hashes, prune)

    def sign(batches):
        s = Shingler(words)
        for c in batches:
            sets = [s.shingles(t) for t in c["text"].to_pylist()]
            yield {"doc_id": c["doc_id"], "n_shingles": [len(x) for x in sets],
                   "key": [set_key(x.tobytes()) for x in sets],
                   "sig": [signature(x, a, b).tobytes() if len(x) else None for x in sets]}
    signed = stash(arrow_map(docs, sign, "doc_id bigint, n_shingles bigint, key string, sig binary"))
    usable = signed.where("doc_id is not null and key is not null")
    sigs = stash(usable.groupBy("key").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
                 .select("key", F.col("m.doc_id").alias("rep"), F.col("m.sig").alias("sig")))

    def band(batches):
        for c in batches:
            x = np.frombuffer(b"".join(c["sig"].to_pylist()), np.uint32).reshape(-1, hashes)
            rep = np.repeat(c["rep"].to_numpy(), bands)
            order = mix(rep.astype(U) * U(4) + np.tile(np.arange(bands, dtype=U) % U(4), len(x)))
            yield {"bucket": band_keys(x, bands).ravel(), "rep": rep, "o": order.view(np.int64)}
    placed = stash(arrow_map(sigs.select("rep", "sig"), band, "bucket bigint, rep bigint, o bigint"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    places = stash(placed.join(shared, "bucket").repartitionByRange("bucket", "o").sortWithinPartitions("bucket", "o"))
    # Sets of all texts that share a bucket: whole texts are shuffled once, both rounds read the written sets.
    full = full_sets(places.select("rep").distinct(), docs, sigs, words)

    def adjacent(batches):
        last_b = last_r = None
        for c in batches:
            bucket, rep = c["bucket"].to_numpy(), c["rep"].to_numpy()
            if last_b is not None:
                bucket, rep = np.append(last_b, bucket), np.append(last_r, rep)
            at = np.flatnonzero((bucket[1:] == bucket[:-1]) & (rep[1:] != rep[:-1]))
            yield {"a": np.minimum(rep[at], rep[at + 1]), "b": np.maximum(rep[at], rep[at + 1])}
            last_b, last_r = bucket[-1], rep[-1]
    pairs = arrow_map(places.select("bucket", "rep"), adjacent, "a bigint, b bigint").distinct()
    links = stash(verified(pairs, full, threshold, least))
    comp = components(links)

    # Buckets whose members are not yet connected: their members with components, cut into blocks that meet pairwise.
    member = (places.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
              .select("bucket", "rep", F.coalesce("component", "rep").alias("comp")))
    member = stash(member)
    open_ = stash(member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
                  .where("lo <> hi").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    member = stash(member.join(open_, "bucket"))
    own = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int")
    spread = (member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .join(full, "rep")
              .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp", "sig", "s"))
    key = ["bucket", "i", "j"]
    dealt = spread.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)
    percent = round(threshold * 100)

    def across(batches):
        names, held, group = (*key, "own", "rep", "comp", "sig", "s"), [], None

        def emit():
            if len({r[5] for r in held}) < 2:
                return
            sig = np.stack([np.frombuffer(r[6], np.uint32) for r in held])
            side, rep, comp_ = (np.array([r[k] for r in held]) for k in (3, 4, 5))
            keys, found = band_keys(sig, bands), []
            for k in range(len(held) - 1):
                to = k + 1 + np.flatnonzero((comp_[k + 1:] != comp_[k]) & ((side[k + 1:] != side[k]) | (group[1] == group[2])))
                to = to[survives(np.broadcast_to(sig[k], (len(to), hashes)), sig[to], least)]
                # A pair is confirmed in the first of its buckets only.
                to = to[keys[k, (keys[to] == keys[k]).argmax(1)] == group[0]] if len(to) else to
                for q in to[np.argsort(-(sig[to] == sig[k]).sum(1), kind="stable")]:
                    if comp_[q] != comp_[k] and similar(np.frombuffer(held[k][7], U), np.frombuffer(held[q][7], U), percent):
                        found.append(sorted((int(rep[k]), int(rep[q]))))
                        comp_[comp_ == comp_[q]] = comp_[k]
            if found:
                yield {"a": [x for x, _ in found], "b": [y for _, y in found]}
        for c in batches:
            for r in zip(*(c[n].to_pylist() for n in names)):
                if r[:3] != group:
                    yield from emit()
                    held, group = [], r[:3]
                held.append(r)
        yield from emit()
    comp = components(links.union(arrow_map(dealt, across, "a bigint, b bigint")))
    classes = stash(sigs.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                    .select("key", F.coalesce("component", "rep").alias("component_id")))
    # A row without an id is no node, so it takes no class.
    own_key = F.when(F.col("doc_id").isNotNull(), F.col("key"))
    return (signed.select("doc_id", "n_shingles", own_key.alias("key")).join(classes, "key", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept")))
