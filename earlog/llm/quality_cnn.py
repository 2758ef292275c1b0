"""Quality classifier: a byte-level convolutional network in numpy, max-pooled over chunks that cover the whole text."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlog.llm.common import arrow_map

#: Bytes of a chunk, width of a filter, filters, size of a byte's vector. Chunks overlap by WIDTH - 1 bytes: no window is lost.
CHUNK, WIDTH, FILTERS, DIM = 512, 6, 16, 6
#: Documents of each label that training reads at most, each with all its chunks.
TRAIN_DOCS = 1500
#: Chunks that are convolved at once.
BLOCK = 64


@dataclass
class Network:
    bytes_: np.ndarray      # 256 x DIM
    filters: np.ndarray     # WIDTH x DIM x FILTERS
    bias: np.ndarray        # FILTERS
    weights: np.ndarray     # 2 * FILTERS: of the maximum and of the mean over chunks
    offset: float

    def tables(self) -> list[np.ndarray]:
        """Response to each pair of bytes at places 0-1, 2-3, 4-5 of a filter: a window is then three look-ups."""
        one = np.einsum("bd,wdf->wbf", self.bytes_, self.filters).astype(np.float32)
        return [(one[j][:, None] + one[j + 1][None]).reshape(65536, -1) for j in range(0, WIDTH, 2)]


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks over all bytes, the last one padded with zeros; an empty text is one chunk of zeros."""
    step = CHUNK - WIDTH + 1
    n = max(1, -(-(len(data) - WIDTH + 1) // step))
    buf = np.zeros((n - 1) * step + CHUNK, np.uint8)
    buf[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, CHUNK)[::step]


def convolve(block: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Responses of all windows of chunks: chunk x window x filter."""
    pair = block[:, :-1].astype(np.int32) << 8 | block[:, 1:]
    n = CHUNK - WIDTH + 1
    out = tables[0][pair[:, :n]]
    for j in range(1, len(tables)):
        out += tables[j][pair[:, 2 * j:2 * j + n]]
    return out


def peaks(pieces: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Window of the largest response of every filter in every chunk, and that response."""
    where, top = [], []
    for k in range(0, len(pieces), BLOCK):
        raw = convolve(pieces[k:k + BLOCK], tables)
        where.append(raw.argmax(1))
        top.append(np.take_along_axis(raw, where[-1][:, None], 1)[:, 0])
    return np.concatenate(where), np.concatenate(top)


def pooled(pieces: np.ndarray, net: Network, tables: list[np.ndarray]) -> np.ndarray:
    """Largest response of every filter in every chunk, after the bias and the rectifier."""
    top = [convolve(pieces[k:k + BLOCK], tables).max(1) for k in range(0, len(pieces), BLOCK)]
    return np.maximum(np.concatenate(top) + net.bias, 0).astype(np.float32)


def probability(features: np.ndarray, net: Network) -> float:
    z = float(np.concatenate([features.max(0), features.mean(0)]) @ net.weights + net.offset)
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts: list[np.ndarray], labels: list[int], epochs: int = 12, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on the log loss, classes weighted alike. The gradient of a maximum flows to the window that reached it."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, .5, (256, DIM)), rng.normal(0, .4, (WIDTH, DIM, FILTERS)), np.zeros(FILTERS),
                  rng.normal(0, .3, 2 * FILTERS), 0.0)
    if not texts:
        return net
    y = np.array(labels, float)
    share = np.where(y == 1, .5 / max(1, y.sum()), .5 / max(1, (1 - y).sum())) * len(y)
    moments: dict[str, list[np.ndarray]] = {}
    step, n = 0, CHUNK - WIDTH + 1
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            pick, tables, step = order[at:at + 32], net.tables(), step + 1
            g = {k: np.zeros_like(getattr(net, k)) for k in ("bytes_", "filters", "bias", "weights")} | {"offset": np.zeros(())}
            for d in pick:
                piece = texts[d]
                where, top = peaks(piece, tables)
                top = top + net.bias
                f = np.maximum(top, 0)
                best = f.argmax(0)
                feats = np.concatenate([f.max(0), f.mean(0)])
                z = np.clip(feats @ net.weights + net.offset, -40, 40)
                e = share[d] * (1 / (1 + np.exp(-z)) - y[d]) / len(pick)
                g["weights"] += e * feats
                g["offset"] += e
                df = np.repeat(e * net.weights[FILTERS:][None] / len(f), len(f), 0)
                df[best, np.arange(FILTERS)] += e * net.weights[:FILTERS]
                df *= top > 0
                g["bias"] += df.sum(0)
                for j in range(WIDTH):
                    b = piece[np.arange(len(piece))[:, None], where + j]                   # chunk x filter
                    vec = net.bytes_[b]                                                    # chunk x filter x DIM
                    g["filters"][j] += np.einsum("cfd,cf->df", vec, df)
                    np.add.at(g["bytes_"], b, df[:, :, None] * net.filters[j].T[None])
            for k, v in g.items():
                m, s = moments.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
                v = v + 1e-4 * getattr(net, k)
                m[...] = .9 * m + .1 * v
                s[...] = .999 * s + .001 * v * v
                by = rate * (1 - epoch / epochs) * (m / (1 - .9 ** step)) / (np.sqrt(s / (1 - .999 ** step)) + 1e-8)
                setattr(net, k, getattr(net, k) - by)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", docs_each: int = TRAIN_DOCS, epochs: int = 12,
          seed: int = 7) -> Network:
    """Network from a bounded sample: of each label the `docs_each` documents of smallest hashed id, with their whole texts.
    Null labels, labels without a document and documents without a label are left out; without any label the untrained
    network is returned. Of ids labelled twice the smaller label counts, of ids with several texts one.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"))
    ids = None
    for v in (0, 1):
        some = known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(docs_each)
        ids = some if ids is None else ids.union(some)
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")     # at most 2 * docs_each ids
    one = picked.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.isnull("text"), F.xxhash64("text"), "text")).alias("text"))
    rows = sorted(one.select("doc_id", "y", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("x")).collect())
    return fit([chunks(bytes(r["x"])) for r in rows], [r["y"] for r in rows], epochs, seed=seed)


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row, from all chunks of the whole text (null: empty). No shuffle.

    Nulls in other columns, ties and repeated rows do not matter; an empty table stays empty; a clashing column is replaced.
    """
    rest = docs.drop(out)
    names = rest.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", `{out}` double"

    def add(batches):
        tables = net.tables()
        for c in batches:
            p = [probability(pooled(chunks((t or "").encode()), net, tables), net) for t in c[text].to_pylist()]
            yield {n: c[n] for n in names} | {out: p}
    return arrow_map(rest, add, schema)
