"""Hidden Markov language model over words, trained by Baum-Welch with counts aggregated over partitions.

A text is its words (A-Z lowered, parted by ASCII white space) and one end token. Hidden states emit symbols, a bounded
alphabet: the end, every frequent word (at least a 2**-14 share of all tokens, so at most 2**14 of them), and buckets of the
remaining words by their ends. Given its symbol, a word has a smoothed probability from corpus counts, with room for an unseen
word in every bucket. So the probabilities of all texts, unseen words included, sum to one.
"""
from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlog.llm.common import arrow_map, stash

#: States, share of a frequent word as a power of two, buckets of other words, words whose meetings give the first states.
STATES, FREQUENT, BUCKETS, ANCHORS = 8, 14, 1024, 256
#: Words with at least a 2**-LOOKED_UP share of the tokens (so at most 2**17) go to the tasks in a table; only rarer ones are joined.
LOOKED_UP = 17
END = b" "              # no word contains a blank
#: Texts that run through the recursion side by side.
SIDE, TOKENS = 4096, 1_000_000
#: Bytes of symbol sequences (two each) that a task gathers before it sorts them by length.
GATHERED = 8_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-3:]) % buckets


@dataclass
class Model:
    start: np.ndarray       # K
    step: np.ndarray        # K x K
    emit: np.ndarray        # symbol x K


class Steps:
    """Sequences by falling length, laid out step by step: a step holds the same place of all sequences that reach it."""

    def __init__(self, seqs: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in seqs], kind="stable")
        lengths = np.array([len(seqs[k]) for k in self.order])
        self.alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        self.edge = np.concatenate([[0], np.cumsum(self.alive)])
        self.bounds = list(zip(self.edge[:-1].tolist(), self.edge[1:].tolist()))
        which = np.arange(self.edge[-1]) - np.repeat(self.edge[:-1], self.alive)             # sequence of each column
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.concatenate([seqs[k] for k in self.order])
        self.which, self.symbol = which, flat[at[which] + np.repeat(np.arange(len(self.alive)), self.alive)]


def _alphas(x: Steps, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions and scaled forward values (state x column), and the scale of every column."""
    e = np.ascontiguousarray(m.emit.T).take(x.symbol, 1)
    a, c, move = np.empty_like(e), np.empty(e.shape[1]), np.ascontiguousarray(m.step.T)
    for t, (lo, hi) in enumerate(x.bounds):
        now, scale = a[:, lo:hi], c[lo:hi]
        if t:
            np.matmul(move, a[:, before:before + hi - lo], out=now)
            now *= e[:, lo:hi]
        else:
            np.multiply(m.start[:, None], e[:, lo:hi], out=now)
        now.sum(0, out=scale)
        now /= scale
        before = lo
    return e, a, c


def forward(seqs: list[np.ndarray], m: Model) -> np.ndarray:
    """Natural log likelihood of every sequence by the scaled forward recursion."""
    x = Steps(seqs)
    out = np.empty(len(seqs))
    out[x.order] = np.bincount(x.which, np.log(_alphas(x, m)[2]), minlength=len(seqs))
    return out


def expected(seqs: list[np.ndarray], m: Model, counts: dict[str, np.ndarray]) -> float:
    """Adds the expected starts, moves and emissions of the sequences to counts; their log likelihood."""
    x = Steps(seqs)
    e, a, c = _alphas(x, m)
    first = x.bounds[0][1]
    beta = np.ones_like(a)
    e /= c                                                               # from here on: what a column gives to the one before it
    for (before, _), (lo, hi) in zip(x.bounds[-2::-1], x.bounds[:0:-1]):
        back = e[:, lo:hi]
        back *= beta[:, lo:hi]
        np.matmul(m.step, back, out=beta[:, before:before + hi - lo])
    rest = np.arange(first, a.shape[1])
    counts["step"] += a.take(rest - np.repeat(x.alive[:-1], x.alive[1:]), 1) @ e[:, first:].T * m.step
    a *= beta
    counts["start"] += a[:, :first].sum(1)
    for j, gamma in enumerate(a):
        counts["emit"][:, j] += np.bincount(x.symbol, gamma, minlength=len(counts["emit"]))
    return float(np.log(c).sum())


def side_by_side(seqs: list[np.ndarray]):
    """Groups of sequences of like length: bounded tables of forward values, few steps in which hardly any text is alive."""
    order = sorted(range(len(seqs)), key=lambda k: len(seqs[k]))
    group, size = [], 0
    for k in order:
        if group and (len(group) >= SIDE or size + len(seqs[k]) > TOKENS):
            yield group
            group, size = [], 0
        group.append(k)
        size += len(seqs[k])
    if group:
        yield group


def gathered(batches):
    """Batches joined up to GATHERED bytes of sequences: more texts of like length run side by side."""
    held, size = [], 0
    for c in batches:
        held.append(c)
        size += c["seq"].nbytes
        if size >= GATHERED:
            yield {k: pa.concat_arrays([h[k] for h in held]) for k in c}
            held, size = [], 0
    if held:
        yield {k: pa.concat_arrays([h[k] for h in held]) for k in held[0]}


def clusters(meet: np.ndarray, k: int) -> np.ndarray:
    """Groups of anchor words by the company they keep: k-means on the rows of the association matrix, farthest first."""
    have = meet.diagonal() > 0
    share = meet / np.maximum(1, meet.diagonal())[:, None]
    x = share - share[have].mean(0) if have.any() else share
    x = x / np.maximum(1e-12, np.linalg.norm(x, axis=1))[:, None]
    pick = [0]
    while len(pick) < min(k, len(x)):
        pick.append(int((x @ x[pick].T).max(1).argmin()))
    centre = x[pick]
    for _ in range(25):
        label = (x @ centre.T).argmax(1)
        centre = np.stack([x[label == j].sum(0) if (label == j).any() else centre[j] for j in range(len(centre))])
        centre /= np.maximum(1e-12, np.linalg.norm(centre, axis=1))[:, None]
    return label


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end token included. Counted per task, then summed: a hot word is one row a task."""
    def count(batches):
        part = Counter()
        for c in batches:
            for t in c["text"].to_pylist():
                part.update(words_of(t))
                part[END] += 1
            if len(part) > 400_000:
                yield {"word": list(part), "n": list(part.values())}
                part.clear()
        yield {"word": list(part), "n": list(part.values())}
    return arrow_map(texts, count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _task_sums(rows: DataFrame, fn, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    """Sums of arrays that fn(batches) gives per task: sparse cells are added by Spark, the totals have a fixed size."""
    def cells(batches):
        for name, a in fn(batches).items():
            flat = np.asarray(a, float).ravel()
            at = np.flatnonzero(flat)
            yield {"name": [name] * len(at), "at": at, "v": flat[at]}
    out = {n: np.zeros(int(np.prod(s))) for n, s in shapes.items()}
    summed = arrow_map(rows, cells, "name string, at int, v double").groupBy("name", "at").agg(F.sum("v").alias("v"))
    for name, part in summed.toPandas().groupby("name"):
        out[name][part["at"].to_numpy()] = part["v"].to_numpy()
    return {n: out[n].reshape(s) for n, s in shapes.items()}


def train(sequences: DataFrame, m: Model, passes: int, floor: float = 0.01) -> Model:
    """Baum-Welch over all training sequences: one Spark job a pass, only state and symbol sums come back."""
    shapes = {"start": m.start.shape, "step": m.step.shape, "emit": m.emit.shape}
    rows = sequences.where("train").select("seq")
    for _ in range(passes):
        def count(batches, m=m):
            sums = {n: np.zeros(s) for n, s in shapes.items()}
            for c in gathered(batches):
                seqs = [np.frombuffer(b, np.uint16) for b in c["seq"].to_pylist()]
                for g in side_by_side(seqs):
                    expected([seqs[k] for k in g], m, sums)
            return sums
        s = _task_sums(rows, count, shapes)
        prior = s["emit"].sum(1, keepdims=True) + 0.5
        emit = s["emit"] + floor * s["emit"].sum(0) * prior / prior.sum() + 1e-9
        step, start = s["step"] + 0.5, s["start"] + 0.5
        m = Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
    return m


def language_model_scores(docs: DataFrame, states: int = STATES, passes: int = 3, frequent: int = FREQUENT,
                          buckets: int = BUCKETS, looked_up: int = LOOKED_UP) -> DataFrame:
    """Per row of documents (doc_id, text, train): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows where `train` is true (null: false) and scores all rows. base_score is the smoothed unigram log10
    probability, score the model's. Null and blank texts are the end token alone. Repeated rows and rows without an id are
    scored one by one. Without any training row every word is unseen. Further columns are ignored.
    """
    docs = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("train", F.lit(False)).alias("train")))
    counts = stash(word_counts(docs.where("train").select("text")))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    is_end, often = F.col("word") == F.lit(END), F.col("n") >= n / 2**looked_up
    # Bounded by the share: at most 2**looked_up words.
    top = counts.where(often & ~is_end).orderBy(F.desc("n"), "word").limit(2**looked_up).collect()
    ends = sum(r["n"] for r in counts.where(is_end).collect())
    table = {END: 0} | {bytes(r["word"]): k + 1 for k, r in enumerate(top)}
    count_of = np.array([ends] + [r["n"] for r in top])
    n_own = 1 + int((count_of[1:] >= n / 2**frequent).sum())            # the end and the most frequent words, in this order
    ns = n_own + buckets
    in_bucket = [bucket_of(w, buckets) for w in list(table)[n_own:]]
    symbol_of = np.array([*range(n_own), *(n_own + b for b in in_bucket)], np.uint16)
    log_count = np.log10(count_of + 0.5)
    log_denominator = float(np.log10(n + 0.5 * (v + 1)))

    # Symbol sequences, what the looked-up words add to the scores, and how often rarer words occur.
    def encode(batches):
        for c in batches:
            out = {k: [] for k in ("seq", "n_tokens", "known", "base", "inside")}
            rare_words, rare_times, edge, get = [], [], [0], table.get
            for t in c["text"].to_pylist():
                ws = words_of(t)
                at = np.array([get(w, -1) for w in ws] + [0])
                seq = symbol_of[at]
                new = np.flatnonzero(at < 0)
                rare = Counter()
                if len(new):
                    odd = [ws[k] for k in new.tolist()]
                    seq[new] = [n_own + bucket_of(w, buckets) for w in odd]
                    rare.update(odd)
                hit = at[at >= 0]
                rare_words += rare.keys()
                rare_times += rare.values()
                edge.append(len(rare_words))
                for name, x in zip(out, (seq.tobytes(), len(seq), int((count_of[hit] > 0).sum()), float(log_count[hit].sum()),
                                         float(log_count[hit[hit >= n_own]].sum()))):
                    out[name].append(x)
            flat = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int32())], ["word", "n"])
            yield out | {"doc_id": c["doc_id"], "train": c["train"], "rare": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), flat)}
    # Row numbers are fixed once the table is written.
    coded = stash(arrow_map(docs, encode, "doc_id bigint, train boolean, seq binary, n_tokens bigint, known bigint, base double, "
                            "inside double, rare array<struct<word:binary,n:int>>").withColumn("row", F.monotonically_increasing_id()))
    sequences = coded.drop("rare")

    # First states: groups of frequent words that keep the same company in the training texts.
    anchors = min(ANCHORS, n_own - 1)

    def meetings(batches):
        meet, freq = np.zeros((anchors, anchors)), np.zeros(ns)
        for c in batches:
            seqs = [np.frombuffer(b, np.uint16) for b in c["seq"].to_pylist()]
            flat, text = np.concatenate(seqs), np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
            freq += np.bincount(flat, minlength=ns)
            have, use = np.zeros((len(seqs), anchors)), (flat > 0) & (flat <= anchors)
            have[text[use], flat[use] - 1] = 1
            meet += have.T @ have
        return {"meet": meet, "freq": freq}
    first = _task_sums(sequences.where("train").select("seq"), meetings, {"meet": (anchors, anchors), "freq": (ns,)})
    emit = np.repeat(first["freq"][:, None] + 0.5, states, 1)
    if anchors:
        label = clusters(first["meet"], states)
        emit[1:anchors + 1] *= np.where(label[:, None] == np.arange(states)[None], 1.0, 0.1)
    emit /= emit.sum(0)
    stay = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(stay, 0.9 if states > 1 else 1.0)
    model = train(sequences, Model(np.full(states, 1 / states), stay, emit), passes)

    # Rarer words: their counts meet the texts that hold them; none has more than a 2**-looked_up share of the training tokens.
    inside = counts.where(~often & ~is_end)

    def bucketed(batches):
        for c in batches:
            yield {"b": [bucket_of(w, buckets) for w in c["word"].to_pylist()], "n": c["n"]}
    sums = np.zeros((buckets, 2))
    np.add.at(sums, in_bucket, np.stack([count_of[n_own:], np.ones(len(in_bucket))], 1))
    for r in (arrow_map(inside, bucketed, "b int, n bigint").groupBy("b")
              .agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()):                  # one row for each bucket
        sums[r["b"]] += r["n"], r["v"]
    room = np.log10(sums[:, 0] + 0.5 * (sums[:, 1] + 1))
    pieces = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    found = (pieces.join(inside.hint("shuffle_hash"), "word", "left")
             .groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("k"),
                                 F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs")))

    def likelihood(batches):
        for c in gathered(batches):
            seqs = [np.frombuffer(b, np.uint16) for b in c["seq"].to_pylist()]
            s = np.empty(len(seqs))
            for g in side_by_side(seqs):
                s[g] = forward([seqs[k] for k in g], model) / np.log(10)
            for k, q in enumerate(seqs):
                s[k] -= room[q[q >= n_own].astype(np.int64) - n_own].sum()
            yield {k: c[k] for k in ("doc_id", "row", "n_tokens", "known", "base", "inside")} | {"s": s}
    scored = arrow_map(sequences, likelihood, "doc_id bigint, row bigint, n_tokens bigint, known bigint, base double, inside double, s double")
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(log_denominator)).alias("base_score"),
        (F.col("s") + F.col("inside") + logs).alias("score"))
