"""Chat formatting as prefix trees: shared first turns are emitted once, depth first, with positions and attention intervals.

Conversations are sorted by the chain of their turns' digests, so those that share first turns are neighbours and the order is
a depth-first walk of the prefix forest. Each one adds the turns that the one before it lacks. A piece is a stretch of the
walk of bounded length; it starts with all turns of its first conversation, so every piece can be read alone.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlog.llm.common import arrow_map

#: The template. A turn is OPEN + role + CLOSE + text + END; inside texts and roles every backslash and every
#: control string gets a backslash before it.
OPEN, CLOSE, END = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|### |</turn>|: ")
# Stretches are taken whole and never given back, so a long text costs no memory for each of its characters.
_TURN = re.compile(r"### ((?:[^\\:]++|\\(?:\\|### |</turn>|: )|:(?! ))*+): ((?:[^\\ ]++|(?! </turn>\n) |\\(?:\\|### |</turn>))*+) </turn>\n")
#: Tokens after which the next conversation starts a new piece.
PIECE_TOKENS = 1 << 20
PLAIN, LOSS = 0, 1


def escape(text: str, role: bool = False) -> str:
    """Backslashes and control strings get a backslash in front; in roles also the separator."""
    return _CONTROL.sub(lambda m: m[0] if m[0] == ": " and not role else "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|### |</turn>|: )", r"\1", text)


def turn_tokens(role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a formatted turn, and which belong to the loss: an assistant's text."""
    head, body = OPEN + escape(role, True) + CLOSE, escape(text)
    t = np.frombuffer((head + body + END).encode("utf-32-le", "surrogatepass"), "<i4")
    loss = np.zeros(len(t), np.int8)
    if role == "assistant":
        loss[len(head):len(head) + len(body)] = LOSS
    return t, loss


def _digest(before: bytes, role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.blake2b(before + len(r).to_bytes(8, "little") + r + text.encode(), digest_size=16).digest()


def chat_tree(conversations: DataFrame, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """One row per conversation, in walk order within a piece:

    piece string; start long: place of its new tokens in the piece; tokens, positions array<int>, loss array<tinyint>: the new
    tokens, their position ids (place on the path from the root) and the loss mask; visible array<struct<lo,hi>>: the
    intervals of the piece that its path consists of, own new tokens last (a token attends to what lies in them before it);
    conv_id; n_turns; turn_ends array<int>: token counts of the path up to each turn's end.

    Turns are ordered by turn (null first), role, text; null roles and texts are empty; repeated rows are turns of their own.
    Rows without conv_id make one conversation. Turns of a conversation come together in one task; equal conversations and
    those of a hot first turn are spread by range over (path, conv_id). Further columns are ignored.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def chain(batches):
        for c in batches:
            paths, turns = [], c["turns"].to_pylist()
            for ts in turns:
                d, p = b"", []
                for t in ts:
                    d = _digest(d, t["role"], t["text"])
                    p.append(d)
                paths.append(b"".join(p))
            yield c | {"path": paths}
    turns = "array<struct<turn:bigint,role:string,text:string>>"
    n_parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walk = (arrow_map(convs, chain, f"conv_id bigint, turns {turns}, path binary")
            .repartitionByRange(n_parts, "path", "conv_id").sortWithinPartitions("path", "conv_id"))

    def emit(batches):
        names = ("piece", "start", "tokens", "positions", "loss", "visible", "conv_id", "n_turns", "turn_ends")
        stack, at, piece, out, held = [], 0, None, {n: [] for n in names}, 0
        for c in batches:
            for i, ts, path in zip(c["conv_id"].to_pylist(), c["turns"].to_pylist(), c["path"].to_pylist()):
                keys = [path[k:k + 16] for k in range(0, len(path), 16)]
                if piece is None or at >= piece_tokens:
                    stack, at, piece = [], 0, hashlib.blake2b(path + repr(i).encode(), digest_size=12).hexdigest()
                same = 0
                while same < min(len(stack), len(keys)) and stack[same][0] == keys[same]:
                    same += 1
                del stack[same:]
                position, start, toks, loss = (stack[-1][3] if stack else 0), at, [], []
                for t, k in zip(ts[same:], keys[same:]):
                    x, m = turn_tokens(t["role"], t["text"])
                    toks.append(x)
                    loss.append(m)
                    end = (stack[-1][3] if stack else 0) + len(x)
                    stack.append((k, at, at + len(x), end))
                    at += len(x)
                new = np.concatenate(toks) if toks else np.empty(0, np.int32)
                visible = []
                for _, lo, hi, _ in stack:
                    if visible and visible[-1]["hi"] == lo:
                        visible[-1]["hi"] = hi
                    else:
                        visible.append({"lo": lo, "hi": hi})
                row = (piece, start, new, np.arange(position, position + len(new), dtype=np.int32),
                       np.concatenate(loss) if loss else np.empty(0, np.int8), visible, i, len(ts), [s[3] for s in stack])
                for n, v in zip(names, row):
                    out[n].append(v)
                held += len(new)
                if held > 500_000 or len(out["piece"]) >= 2000:
                    yield out
                    out, held = {n: [] for n in names}, 0
        yield out
    return arrow_map(walk, emit, "piece string, start bigint, tokens array<int>, positions array<int>, loss array<tinyint>, "
                     "visible array<struct<lo:bigint,hi:bigint>>, conv_id bigint, n_turns bigint, turn_ends array<int>")


def parse(formatted: str, loss: np.ndarray) -> tuple[list[tuple[str, str]], str]:
    """Turns (role, text) of a formatted conversation, and the unescaped text under the loss mask."""
    turns, at, lost = [], 0, []
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("the stream is not a sequence of turns")
        at = m.end()
        turns.append((unescape(m[1]), unescape(m[2])))
        mask = loss[m.start(2):m.end(2)]
        if len(mask) and mask.all():
            lost.append(turns[-1][1])
        elif mask.any():
            points = np.frombuffer(m[2].encode("utf-32-le", "surrogatepass"), "<u4")
            lost.append(unescape(points[mask == LOSS].tobytes().decode("utf-32-le", "surrogatepass")))
    if at != len(formatted):
        raise ValueError("the stream is not a sequence of turns")
    return turns, "".join(lost)


def read_back(tree: DataFrame) -> DataFrame:
    """Per conversation what its visible intervals spell: conv_id, formatted, loss_text, roles, texts.

    Pieces are read in walk order; only the tokens of the current path are held. A tree that was written and read again is
    brought in order by piece and start.
    """
    n_parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tree.repartition(n_parts, "piece").withColumn("_new", F.size("tokens") > 0).sortWithinPartitions("piece", "start", "_new")

    def read(batches):
        piece, held = None, []          # held: (lo, hi, tokens, loss) of the current path
        for c in batches:
            out = {n: [] for n in ("conv_id", "formatted", "loss_text", "roles", "texts")}
            edge = c["tokens"].offsets.to_numpy() - c["tokens"].offsets[0].as_py()
            flat, mask = (c[n].flatten().to_numpy() for n in ("tokens", "loss"))
            for k, (p, start, vis, i) in enumerate(zip(*(c[n].to_pylist() for n in ("piece", "start", "visible", "conv_id")))):
                if p != piece:
                    piece, held = p, []
                if edge[k] < edge[k + 1]:
                    # Copies: the path is held for longer than the batch.
                    held.append((start, start + int(edge[k + 1] - edge[k]), flat[edge[k]:edge[k + 1]].copy(), mask[edge[k]:edge[k + 1]].copy()))
                parts, masks, keep = [], [], []
                for v in vis:
                    for lo, hi, x, m in held:
                        a, b = max(lo, v["lo"]), min(hi, v["hi"])
                        if a < b:
                            parts.append(x[a - lo:b - lo])
                            masks.append(m[a - lo:b - lo])
                            keep.append((a, b, parts[-1], masks[-1]))
                held = keep
                text = b"".join(x.tobytes() for x in parts).decode("utf-32-le", "surrogatepass")
                turns, lost = parse(text, np.concatenate(masks) if masks else np.empty(0, np.int8))
                for n, v in zip(out, (i, text, lost, [r for r, _ in turns], [t for _, t in turns])):
                    out[n].append(v)
            yield out
    return arrow_map(ordered, read, "conv_id bigint, formatted string, loss_text string, roles array<string>, texts array<string>")
