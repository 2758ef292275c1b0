"""Distinct sampled segmentations of texts: Gumbel top-k without replacement by perturbed A* search over the piece lattice.

The lattice of a text is a chain of word lattices, as no piece goes past the start of a run of blanks. A backward pass gives
every word's total weight; then the search keeps, for each text, sets of segmentations with the largest perturbed score in
each set. The set with the largest score is taken: a segmentation is drawn from it, which has exactly that score, and the rest
splits into one set for each word at which another segmentation could leave it; their scores are truncated Gumbel draws. So
the k-th set taken holds the k-th largest perturbed score of all segmentations, and the next one gives the inclusion scores.
Texts of a batch take their steps together in numpy. All random numbers are hashes of row key, round, word and step.
"""
from __future__ import annotations

import hashlib
import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from earlog.llm.common import arrow_map

K, ALPHA = 2, 0.5
BLANK, FLAG = 0x2581, 1 << 21
#: Texts and code points of a batch; code points of words whose lattices are kept from batch to batch; code points laid out at once.
DOCS, CHARS, HELD, LAID = 300, 3_000_000, 3_000_000, 300_000
_RUN = re.compile(" +[^ ]*")
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(30)) * U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> U(27)) * U(0x94D049BB133111EB)
    return h ^ h >> U(31)


def chained(*parts, h: np.ndarray = np.zeros(1, U)) -> np.ndarray:
    """Hashes, one for each combination of the (broadcast) integer parts, going on from h."""
    for p in parts:
        h = mix((h + U(0x9E3779B97F4A7C15)) ^ np.asarray(p).astype(U))
    return h


def uniform(*parts, h: np.ndarray = np.zeros(1, U)) -> np.ndarray:
    """Numbers in (0, 1), one for each combination of the (broadcast) integer parts, going on from h."""
    return ((chained(*parts, h=h) >> U(11)).astype(float) + 0.5) * 2.0**-53


class Lattice:
    """The pieces of a SentencePiece model as a trie in a hash table, with log weights.

    Merge-ranked models have no probabilities: a piece of rank r weighs as 1 / (r + 2) (Zipf's law), byte pieces as the last
    rank. `alpha` flattens the weights. A character without a piece is one arc: its bytes.
    """

    def __init__(self, model_file: str, alpha: float = ALPHA):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        self.raw: list[bytes] = [b""] * n
        trie, piece_at, weight_at = {}, [-1], [0.0]
        score = np.array([sp.get_score(i) for i in range(n)])
        ranked = (score == score.round()).all()
        self.weight = np.zeros(n)
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        logs = -np.log(2.0 - score) if ranked else score
        low = logs[usable].min()
        for i in usable:
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(s[3:5], 16)] = i
                self.raw[i], self.weight[i] = bytes([int(s[3:5], 16)]), alpha * low
                continue
            self.raw[i], self.weight[i] = s.replace(chr(BLANK), " ").encode(), alpha * logs[i]
            if chr(BLANK) in s.lstrip(chr(BLANK)):
                continue
            node = 0
            for ch in s:
                key = node << 22 | ord(ch)
                node = trie.setdefault(key, len(piece_at))
                if node == len(piece_at):
                    piece_at.append(-1)
                    weight_at.append(-np.inf)
            piece_at[node], weight_at[node] = i, self.weight[i]
        self.raw_size = np.array([len(r) for r in self.raw], np.int32)
        self.raw_at = (np.cumsum(self.raw_size) - self.raw_size).astype(np.int32)
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.piece = np.array(piece_at)
        self.node_weight = np.array(weight_at)
        self.bits = max(10, (8 * len(trie)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys, nodes = np.array(list(trie)), np.array(list(trie.values()))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.nodes[slot[put]] = keys[put], nodes[put]
            rest = np.setdiff1d(np.arange(len(keys)), put)
            keys, nodes, slot = keys[rest], nodes[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U) * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def child(self, keys: np.ndarray) -> np.ndarray:
        """Trie nodes for (node, character) keys, -1 where there is none."""
        slot = self._slot(keys)
        out, have = np.full(len(keys), -1), self.keys[slot]
        hit = have == keys
        out[hit] = self.nodes[slot[hit]]
        left = np.flatnonzero(~hit & (have != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot[left]]
            hit = have == keys[left]
            out[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (have != -1)]
        return out


def appended(buffer: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """The buffer with new values behind its first n; its room doubles when it is full."""
    if n + len(new) > len(buffer):
        old, buffer = buffer, np.empty(max(2 * len(buffer), n + len(new)), buffer.dtype)
        buffer[:n] = old[:n]
    buffer[n:n + len(new)] = new
    return buffer


class Words(dict):
    """Numbers of different words (without their first blank) and their lattices: per character its arcs with length, weight and cumulative probability.

    Words stay from batch to batch, so common ones are laid out once; a full store is given up between batches.
    """

    def __init__(self, lat: Lattice):
        super().__init__()
        self.lat, self.new, self.chars, self.arcs_ = lat, [], 0, 0
        self.at, self.length, self.total = np.empty(1, np.int64), np.empty(1, np.int64), np.empty(1)
        self.first = np.empty(1, np.int64)                            # arc number of each character's first arc
        self.arc, self.size, self.weight, self.cdf = np.empty(1, np.int32), np.empty(1, np.int16), np.empty(1), np.empty(1)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def lay_out(self):
        """Lattices of the words met since the last call, some at a time."""
        new, known = self.new, len(self) - len(self.new)
        upto = np.cumsum([len(w) + 1 for w in new])
        a = 0
        while a < len(new):
            b = max(a + 1, int(np.searchsorted(upto, LAID + (upto[a - 1] if a else 0), side="right")))
            self._add(new[a:b], known + a)
            a = b
        self.new = []

    def restart(self):
        """Gives all words up; the room stays."""
        self.clear()
        self.chars = self.arcs_ = 0

    def _add(self, words: list[str], known: int):
        lat = self.lat
        cp = np.frombuffer(" ".join(["", *words]).encode("utf-32-le"), "<u4").astype(np.int64)
        cp = np.where(cp == BLANK, BLANK | FLAG, np.where(cp == 32, BLANK, cp))
        size = np.array([len(w) + 1 for w in words], np.int64)
        at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        left = np.repeat(at + size, size) - np.arange(len(cp))           # characters to the end of the word
        found, alive, node = [], np.arange(len(cp)), np.zeros(len(cp), np.int64)
        while len(alive):
            ok = left[alive] > len(found)
            alive, node = alive[ok], node[ok]
            node = lat.child(node << 22 | cp[alive + len(found)])
            ok = node >= 0
            alive, node = alive[ok], node[ok]
            found.append((alive, node))
        # Characters without a piece of their own have one arc more, their bytes.
        lone = np.ones(len(cp), bool)
        found = [(at_[ok], node[ok]) for at_, node in found for ok in [lat.piece[node] >= 0]]
        if found:
            lone[found[0][0]] = False
        n = lone.astype(np.int64)
        for at_, _ in found:
            n[at_] += 1
        first = np.cumsum(n) - n
        place, arcs = first.copy(), int(n.sum())
        arc, reach, weight = np.empty(arcs, np.int32), np.empty(arcs, np.int16), np.empty(arcs)
        odd = np.flatnonzero(lone)
        real = cp[odd] & (FLAG - 1)
        arc[place[odd]], reach[place[odd]] = -3 - real, 1
        weight[place[odd]] = lat.weight[lat.byte[0]] * (1 + (real > 0x7F) + (real > 0x7FF) + (real > 0xFFFF))
        place[odd] += 1
        for length, (at_, node) in enumerate(found, 1):
            to = place[at_]
            arc[to], reach[to], weight[to] = lat.piece[node], length, lat.node_weight[node]
            place[at_] = to + 1
        del found
        # Backwards from the ends of all words at once; beta has one place more per word, its end.
        beta, sums, cdf = np.zeros(len(cp) + len(words)), np.empty(len(cp)), np.empty(arcs)
        order = np.argsort(-size, kind="stable")
        ends, falling = (at + size)[order], -size[order]
        for back in range(1, int(size.max(initial=0)) + 1):
            many = np.searchsorted(falling, -back, side="right")
            pos, no = ends[:many] - back, order[:many]
            top, s, live, steps = np.full(many, -np.inf), np.zeros(many), np.arange(many), []
            while len(live):
                k = first[pos[live]] + len(steps)
                cdf[k] = v = weight[k] + beta[pos[live] + no[live] + reach[k]]
                top[live] = np.maximum(top[live], v)
                steps.append((live, k))
                live = live[n[pos[live]] > len(steps)]
            for live, k in steps:
                s[live] += np.exp(cdf[k] - top[live])
                cdf[k] = s[live]
            beta[pos + no], sums[pos] = top + np.log(s), s
        cdf /= np.repeat(sums, n)
        cdf[first + n - 1] = 1.0
        self.at, self.length = appended(self.at, known, self.chars + at), appended(self.length, known, size)
        self.total = appended(self.total, known, beta[at + np.arange(len(words))])
        self.first = appended(self.first, self.chars, self.arcs_ + first)
        self.arc, self.cdf = appended(self.arc, self.arcs_, arc), appended(self.cdf, self.arcs_, cdf)
        self.weight = appended(self.weight, self.arcs_, weight)
        self.size = appended(self.size, self.arcs_, reach)
        self.chars, self.arcs_ = self.chars + len(cp), self.arcs_ + arcs

    def draw(self, word: np.ndarray, h: np.ndarray):
        """A random segmentation of each word occurrence (hashes h): piece ids, their number and the log probability of each."""
        n = len(word)
        pos, active = self.at[word], np.arange(n)
        end = pos + self.length[word]
        logp, count, steps, t = -self.total[word], np.zeros(n, np.int64), [], 0
        while len(active):
            u = uniform(t, h=h)
            pick = self.first[pos]
            more = np.flatnonzero(u > self.cdf[pick])
            while len(more):
                pick[more] += 1
                more = more[u[more] > self.cdf[pick[more]]]
            logp[active] += self.weight[pick]
            steps.append((active, self.arc[pick]))
            pos = pos + self.size[pick]
            t += 1
            go = pos < end
            count[active[~go]] = t
            active, pos, end, h = active[go], pos[go], end[go], h[go]
        offset = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(offset[-1], np.int32)
        for t, (a, ids) in enumerate(steps):
            out[offset[a] + t] = ids
        return out, offset, np.minimum(logp, 0.0)

    def arcs(self, pos: int) -> tuple[list[int], list[int], list[float]]:
        """Lengths and pieces that start at a position (characters without one as -3 - code point), and their probabilities."""
        a = b = int(self.first[pos])
        while self.cdf[b] < 1.0:
            b += 1
        # Arcs behind a cumulative probability of 1 are below its rounding; a position's last arc always has 1.
        own = slice(a, b + 1)
        return self.size[own].tolist(), self.arc[own].tolist(), np.diff(self.cdf[own], prepend=0.0).tolist()

    def draw_other(self, word: int, taken: dict[tuple, float], key: tuple) -> tuple[tuple, float]:
        """A random segmentation that is none of those taken (with log probabilities), and its log probability among all."""
        pos, end, ids, logp = int(self.at[word]), int(self.at[word] + self.length[word]), [], 0.0
        rest = {s: math.exp(lp) for s, lp in taken.items()}                     # probability given the path so far
        us = uniform(*key, 1000 + np.arange(end - pos)).tolist()
        while pos < end:
            at, arcs, p = self.arcs(pos)
            free = list(p)
            for s, q in rest.items():
                free[arcs.index(s[len(ids)])] -= q
            free = [max(0.0, f) for f in free]
            if sum(free) <= 0:
                free = p
            u, k = us[len(ids)] * sum(free), 0
            while k < len(free) - 1 and (u > free[k] or free[k] == 0):
                u -= free[k]
                k += 1
            if free[k] == 0:
                k = max(j for j, f in enumerate(free) if f > 0)
            rest = {s: q / p[k] for s, q in rest.items() if s[len(ids)] == arcs[k]}
            logp += math.log(p[k])
            ids.append(arcs[k])
            pos += at[k]
        return tuple(ids), min(logp, 0.0)


def truncated(phi: np.ndarray, top, u: np.ndarray) -> np.ndarray:
    """Gumbel draws with location phi, truncated at top."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        g = phi - np.log(np.exp(phi - top) - np.log(u))
    return np.where(np.isfinite(phi), g, -np.inf)


def rest_of(logp: np.ndarray) -> np.ndarray:
    """log(1 - p); what is below the rounding of p counts as nothing."""
    q = -np.expm1(logp)
    with np.errstate(divide="ignore"):
        return np.where(q > 1e-12, np.log(q), -np.inf)


def final_ids(ids: np.ndarray, lat: Lattice) -> np.ndarray:
    """Characters without a piece become their byte pieces."""
    if ids.min(initial=0) >= 0:
        return ids
    odd = np.flatnonzero(ids < 0)
    parts, last = [], 0
    for k in odd:
        parts += [ids[last:k], lat.byte[list(chr(-3 - ids[k]).encode())]]
        last = k + 1
    return np.concatenate([*parts, ids[last:]]).astype(np.int32)


def decode(ids: np.ndarray, lat: Lattice) -> str:
    """The text that pieces spell; the blank in front of it belongs to the encoding."""
    raw = lat.raw
    return b"".join(map(raw.__getitem__, ids.tolist())).decode()[1:]


def lists_of(rows: list[np.ndarray]) -> pa.Array:
    """Piece ids of several rows as one Arrow column."""
    edge = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def texts_of(rows: list[np.ndarray], lat: Lattice) -> pa.Array:
    """What `decode` gives for each row, for all rows at once: bytes are gathered by the places of their pieces."""
    flat = np.concatenate([np.empty(0, np.int32), *rows])
    size = lat.raw_size[flat]
    upto = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = lat.raw_bytes[np.repeat(lat.raw_at[flat] - upto[:-1], size) + np.arange(upto[-1], dtype=np.int32)]
    edge = upto[np.cumsum([0, *map(len, rows)])]
    filled = np.flatnonzero(np.diff(edge) > 0)
    data = np.delete(data, edge[filled])                        # the blank in front
    drop = np.zeros(len(edge), np.int32)
    drop[filled + 1] = 1
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(edge - np.cumsum(drop, dtype=np.int32)), pa.py_buffer(data))


def split_words(text: str) -> list[str]:
    """The text, with a blank in front, cut before every run of blanks; each word without its first blank."""
    words = text.split(" ") if text else []
    return [w[1:] for w in _RUN.findall(" " + text)] if "" in words else words


def sample_batch(texts: list[str], seeds: np.ndarray, k: int, lat: Lattice, words: Words | None = None):
    """For every text up to k tuples (rank, perturbed score, log probability, inclusion score, ids), best first."""
    words = Words(lat) if words is None else words
    docs = [list(map(words.__getitem__, split_words(t))) for t in texts]
    words.lay_out()
    sizes = np.array([len(d) for d in docs])
    word = np.concatenate([np.array(d, np.int64) for d in docs]) if len(docs) else np.empty(0, np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(word)) - np.repeat(base[:-1], sizes)
    results: list[list] = [[] for _ in texts]
    heaps: list[list] = [[] for _ in texts]
    # A set: (-score, serial, parent path, word place, log probability before it, segmentations that are taken out there).
    paths: list[list] = [[] for _ in texts]

    def settle(r: int, which: list[int], first: list[int], lead: list, top: np.ndarray, logp0: np.ndarray):
        """Completes the paths of texts `which` from word place `first`, adds them and the sets that they leave."""
        occ = np.concatenate([np.arange(base[d] + f, base[d + 1]) for d, f in zip(which, first)]) if which else np.empty(0, np.int64)
        n = np.array([base[d + 1] - base[d] - f for d, f in zip(which, first)], np.int64)
        h = chained(np.repeat(seeds[which], n), r, place[occ])
        ids, offset, lp = words.draw(word[occ], h)
        edge = np.concatenate([[0], np.cumsum(n)])
        prefix = np.empty(len(occ))
        for q, d in enumerate(which):
            a, b = edge[q], edge[q + 1]
            run = logp0[q] + np.cumsum(lp[a:b])
            prefix[a:a + 1], prefix[a + 1:b] = logp0[q], run[:-1]
            own = ids[offset[a]:offset[b]]
            path = (lead[q] + [own], offset[a:b + 1] - offset[a], first[q], lp[a:b])
            paths[d].append(path)
            full = path[0][0] if len(path[0]) == 1 else np.concatenate(path[0])
            results[d].append((float(top[q]), float(run[-1] if b > a else logp0[q]), full))
        left = truncated(prefix + rest_of(lp), np.repeat(top, n), uniform(500, h=h))
        for q, d in enumerate(which):
            a, g = edge[q], left[edge[q]:edge[q + 1]]
            own, cuts = paths[d][-1][0][-1], paths[d][-1][1]
            keep = np.flatnonzero(np.isfinite(g))
            if len(keep) > k:
                keep = keep[np.argpartition(-g[keep], k)[:k]]
            for j in keep:
                seg = tuple(own[cuts[j]:cuts[j + 1]].tolist())
                heapq.heappush(heaps[d], (-float(g[j]), len(paths[d]), first[q] + int(j), len(paths[d]) - 1, float(prefix[a + j]), {seg: float(lp[a + j])}))

    everyone = list(range(len(texts)))
    settle(0, everyone, [0] * len(texts), [[] for _ in texts], -np.log(-np.log(uniform(seeds, 0, 999))), np.zeros(len(texts)))
    for r in range(1, k):
        which, first, lead, top, logp0 = [], [], [], [], []
        for d in everyone:
            if not heaps[d]:
                continue
            score, _, j, parent, before, out = heapq.heappop(heaps[d])
            w, key = int(word[base[d] + j]), (seeds[d:d + 1], r, j)
            seg, lp = words.draw_other(w, out, key)
            blocks, cuts, start, _ = paths[d][parent]
            kept = blocks[:-1] + [blocks[-1][:cuts[j - start]]] + [np.array(seg, np.int32)]
            out = out | {seg: lp}
            left = 1 - sum(map(math.exp, out.values()))
            if left > 1e-12:
                phi = before + math.log(left)
                g = float(truncated(np.array([phi]), -score, uniform(*key, 501))[0])
                heapq.heappush(heaps[d], (-g, -r, j, parent, before, out))
            which.append(d)
            first.append(j + 1)
            lead.append(kept)
            top.append(-score)
            logp0.append(before + lp)
        if which:
            settle(r, which, first, lead, np.array(top), np.array(logp0))
    for d in everyone:
        bound = -heaps[d][0][0] if heaps[d] else -np.inf
        rows = []
        for rank, (g, lp, ids) in enumerate(results[d]):
            inclusion = float(-np.expm1(-np.exp(min(700.0, lp - bound)))) if np.isfinite(bound) else 1.0
            rows.append((rank, g, lp, inclusion, final_ids(ids, lat)))
        yield rows


def row_seed(key, text: str, seed: int) -> int:
    name = repr(key) if key is not None else "text:" + text
    return int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def sample_segmentations(docs: DataFrame, model_file: str, k: int = K, alpha: float = ALPHA, seed: int = 17, with_text: bool = False) -> DataFrame:
    """Rows (doc_id, rank, perturbed, log_prob, inclusion, ids[, decoded]): up to k different segmentations of each whole text.

    rank 0 has the largest perturbed score. inclusion is the chance to be among the k, given the next perturbed score. Texts
    with fewer segmentations give fewer rows; null and empty texts give one without pieces. The random numbers depend on the
    id (null: the text) and the seed alone, so repeated rows repeat their results. No shuffle; further columns are ignored.
    """
    names = ("doc_id", "rank", "perturbed", "log_prob", "inclusion", "ids") + ("decoded",) * with_text

    def sample(batches):
        lat = Lattice(model_file, alpha)
        words = Words(lat)
        for c in batches:
            ids, texts = c["doc_id"].to_pylist(), [t or "" for t in c["text"].to_pylist()]
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and b - a < DOCS and (b == a or size + len(texts[b]) <= CHARS):
                    size += len(texts[b])
                    b += 1
                seeds = np.array([row_seed(i, t, seed) for i, t in zip(ids[a:b], texts[a:b])], U)
                out = {n: [] for n in names}
                for i, rows in zip(ids[a:b], sample_batch(texts[a:b], seeds, k, lat, words)):
                    for row in rows:
                        for n, v in zip(names, (i, *row)):
                            out[n].append(v)
                rows = out["ids"]
                yield out | {"ids": lists_of(rows)} | ({"decoded": texts_of(rows, lat)} if with_text else {})
                a = b
                if words.chars > HELD:
                    words.restart()
    return arrow_map(docs.select("doc_id", "text"), sample, "doc_id bigint, rank int, perturbed double, log_prob double, "
                     "inclusion double, ids array<int>" + ", decoded string" * with_text)
