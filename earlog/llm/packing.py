"""Packing of token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups."""
from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from earlog.llm.common import arrow_map, spare, stash

LENGTH, END_ID = 2048, 1
#: Expected pieces of a group: one task packs a group at a time and holds only lengths and short keys of it.
GROUP_PIECES = 8192


class WordEncoder:
    """Token ids of whole texts. The tokenizer drops white space and never merges across it, so each word is encoded once.

    A word of Latin letters is one unit of the tokenizer and ends with exactly one token of its word-end class; many such
    words are encoded in one call and cut there. All other words are encoded one by one.
    """

    PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    MOST = 1_000_000

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_file)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _one_by_one(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _letters(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 512):
            part = words[k:k + 512]
            ids = np.array(self.tok.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                self._one_by_one(part)
                continue
            raw, at = ids.tobytes(), 0
            for w, c in zip(part, (cuts * 4).tolist()):
                self.known[w] = raw[at:c]
                at = c

    def learn(self, words: set[bytes]) -> None:
        plain, rest, join = set(), [], []
        for w in words:
            core = w.rstrip(self.PUNCTUATION)
            if b"<|" not in w and (core.isalpha() or (t := core.decode()).isalpha() and max(t) < "ɐ" and "İ" not in t):
                plain.add(core)
                if len(core) < len(w):
                    join.append((w, core, w[len(core):]))
            else:
                rest.append(w)
        marks = {m for *_, m in join if m not in self.known}
        self._one_by_one([*marks.union(rest)])
        self._letters([w for w in plain if w not in self.known])
        for w, core, mark in join:
            self.known[w] = self.known[core] + self.known[mark]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        # The tokenizer lowers all letters, but special tokens are found before that.
        split = [(raw if b"<|" in raw else raw.lower()).split() for raw in map(str.encode, texts)]
        if len(self.known) > self.MOST:
            self.known.clear()
        self.learn({w for w in set().union(*split) if w not in self.known})
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def token_pieces(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, ids_crc32, salt, ids): each text's ids and one end id, cut every `length` ids.

    Null texts count as empty and give the end id alone; null ids and repeated rows are pieces of their own. No shuffle.
    """
    schema = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, salt bigint" + ", ids array<int>" * with_ids

    def cut(batches):
        enc, salt, end = WordEncoder(tokenizer_file), 0, np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "salt"] + ["ids"] * with_ids
        for c in batches:
            out = {n: [] for n in names}
            texts, ids = c["text"].to_pylist(), c["doc_id"].to_pylist()
            for at in range(0, len(texts), 250):
                for i, raw in zip(ids[at:at + 250], enc.encode([t or "" for t in texts[at:at + 250]])):
                    raw += end
                    total, salt = len(raw) // 4, salt + 1
                    for s in range(0, total, length):
                        piece = raw[4 * s:4 * (s + length)]
                        for n, v in zip(names, (i, s, len(piece) // 4, total, zlib.crc32(piece), salt)):
                            out[n].append(v)
                        if with_ids:
                            out["ids"].append(np.frombuffer(piece, "<i4"))
            yield out
    return arrow_map(docs.select("doc_id", "text"), cut, schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; items must be sorted by falling length. The tree's nodes hold the largest free space below."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, size in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = LENGTH, group_pieces: int = GROUP_PIECES, seed: int = 11) -> DataFrame:
    """Adds sequence_id and offset: no sequence holds more than `capacity` tokens, its pieces lie side by side from 0.

    Pieces are dealt to random groups by a hash of id, start and salt, as many groups as the count asks for, so no group
    depends on the data; ties in length fall in hash order. Pieces of length 0 or null, and longer ones than the capacity,
    are an error of the caller. Null ids and repeated rows are packed like others; an empty table stays empty.
    """
    pieces = stash(pieces)                  # counted and dealt from one written copy: texts are encoded once
    groups = max(1, -(-pieces.count() // group_pieces))
    parts = min(groups, 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    h = F.xxhash64("doc_id", "start", *(["salt"] if "salt" in pieces.columns else []), F.lit(seed))
    hash_, deal = spare(pieces.columns, "_h", "_group")
    dealt = pieces.drop("sequence_id", "offset").withColumn(hash_, h).withColumn(deal, F.pmod(hash_, F.lit(groups)))
    dealt = dealt.repartition(parts, deal).sortWithinPartitions(deal, F.desc("length"), hash_)
    keep = [f for f in dealt.schema if f.name not in (hash_, deal)]
    schema = StructType([*keep, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches):
        import pyarrow as pa
        held, group = [], None

        def emit():
            size = np.concatenate([x["length"].to_numpy(zero_copy_only=False) for x in held])
            bins, offsets = first_fit_decreasing(size, capacity)
            cols = {f.name: pa.concat_arrays([x[f.name] for x in held]) for f in keep}
            return cols | {"sequence_id": (group << 32) + bins, "offset": offsets}
        for c in batches:
            g = c[deal].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                if held and int(g[a]) != group:
                    yield emit()
                    held = []
                group = int(g[a])
                held.append({n: v.slice(a, b - a) for n, v in c.items()})
        if held:
            yield emit()
    return arrow_map(dealt, place, schema)
