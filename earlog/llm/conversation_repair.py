"""Repair of conversation structure at least cost, by a Viterbi search that runs over all chunks of a conversation at once.

Every turn is kept (cost 0), given the role user or assistant (2) or deleted (3); an empty turn of either role may be inserted
anywhere (2); a kept or re-roled turn whose text breaks off costs 1 more; blank and repeated turns must be deleted. What is left
must read `s?(ua)+` or be nothing. Of the cheapest edits the one whose letters (D, I, K, R) come first in ASCII order is taken.

Four states (nothing yet, after system, after user, after assistant) make the search a product of min-plus matrices over turns.
Costs are counted from the end. A conversation is cut into chunks of bounded size and each starts at its right end from a
speculative cost vector, as if it were the last. The true vector there is not known yet, so fix-up passes rerun the chunk from the
other vectors that can come in, each only until its vector differs from the first run's by a constant: from there on both agree in
every choice. Vectors that differ by more than a constant are few (16, found by `_family`), so all fix-up passes of a chunk are
bounded and are made in its own task; ranks mostly fall within a few turns, and where they never do (all roles unknown) the
reruns still cover every case. Then one summary a chunk is stitched right to left, which gives true costs at every border, and
left to right, which gives the state each chunk starts from; the chunks trace their edits from there, again all at once.

Turns travel as a code, a digest and a turn number, never as text; texts meet the surviving turns by (conversation, turn, digest).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earlog.llm.common import arrow_map, stash

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
#: Distinct turns of a chunk.
CHUNK = 4096
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the only turn that may be appended by an insertion or a new role.
NEXT = (USER, USER, ASSISTANT, USER)
#: By role initial (s, u, a, other): state -> state when the turn is kept.
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
#: Code of a turn that must go; other codes are 1 + 2 * initial + broken.
FORCED, CODES = 0, 9
NEVER = 1 << 40
NAMES = {USER: "user", ASSISTANT: "assistant"}


def _close(v: list[int]) -> list[int]:
    """Costs when turns may be inserted first."""
    for _ in range(3):
        v = [min(v[s], INSERT + v[NEXT[s]]) for s in range(4)]
    return v


def _before(v: list[int], code: int) -> list[int]:
    """Costs in front of a turn from the costs behind it."""
    if code == FORCED:
        return _close([DELETE + x for x in v])
    initial, broken = divmod(code - 1, 2)
    w = []
    for s in range(4):
        ways = [DELETE + v[s], REROLE + broken * BROKEN + v[NEXT[s]]]
        if s in KEPT[initial]:
            ways.append(KEEP + broken * BROKEN + v[KEPT[initial][s]])
        w.append(min(ways))
    return _close(w)


def _normal(v: list[int]) -> tuple[tuple[int, ...], int]:
    return tuple(x - min(v) for x in v), min(v)


def _family():
    """All cost vectors up to constants that any sequence of turns leads to, and how a turn moves between them."""
    kinds = [_normal(_close([0, NEVER, NEVER, 0]))[0]]
    move, gain = [], []
    for v in kinds:                                              # grows while it is read
        for code in range(CODES):
            w, least = _normal(_before(list(v), code))
            if w not in kinds:
                kinds.append(w)
            move.append(kinds.index(w))
            gain.append(least)
    shape = (len(kinds), CODES)
    return kinds, np.array(move).reshape(shape).tolist(), np.array(gain).reshape(shape).tolist()


KINDS, MOVE, GAIN = _family()
#: Vector behind the last turn of a conversation: the speculative start of every chunk.
LAST = 0


def _choice(kind: int, code: int, state: int) -> tuple[str, int]:
    """Edits of one turn, least letter first among the cheapest, and the state behind it."""
    v = list(KINDS[kind])
    w = _before(v, code)
    edits = ""
    while True:
        if DELETE + v[state] == w[state]:
            return edits + "D", state
        if INSERT + w[NEXT[state]] == w[state]:
            edits, state = edits + "I", NEXT[state]
            continue
        initial, broken = divmod(code - 1, 2)
        to = KEPT[initial].get(state)
        if to is not None and KEEP + broken * BROKEN + v[to] == w[state]:
            return edits + "K", to
        return edits + "R", NEXT[state]


CHOICE = [[[_choice(k, c, s) for s in range(4)] for c in range(CODES)] for k in range(len(KINDS))]
TO = [[[CHOICE[k][c][s][1] for s in range(4)] for c in range(CODES)] for k in range(len(KINDS))]


def backward(codes: bytes, kind: int) -> tuple[bytearray, int]:
    """Kind of the vector at every border (the last is `kind`), and the constant that the whole run adds."""
    kinds, total = bytearray(len(codes) + 1), 0
    kinds[-1] = kind
    for i in range(len(codes) - 1, -1, -1):
        total += GAIN[kind][codes[i]]
        kind = kinds[i] = MOVE[kind][codes[i]]
    return kinds, total


def speculate(codes: bytes, extra: int) -> tuple[list[int], list[int], list[int]]:
    """For every vector that can come in from the right: kind at the left end, constant, and end state for each start state.

    The first run starts from `LAST`; the others are fix-up passes that stop where their vector is parallel to the first run's.
    `extra` copies of turns are deleted beside.
    """
    n = len(codes)
    base, whole = backward(codes, LAST)
    upto = [0] * (n + 1)                                         # constant of the first run from the right end to each border
    for i in range(n - 1, -1, -1):
        upto[i] = upto[i + 1] + GAIN[base[i + 1]][codes[i]]
    paths = []
    for state in range(4):
        path = bytearray(n + 1)
        path[0] = state
        for i, c in enumerate(codes):
            state = path[i + 1] = TO[base[i + 1]][c][state]
            if paths and state == paths[0][i + 1]:
                path[i + 1:] = paths[0][i + 1:]
                break
        paths.append(path)
    left, added, ends = [], [], []
    for start in range(len(KINDS)):
        kind, total, i, tail = start, 0, n, []
        while i and kind != base[i]:
            i -= 1
            total += GAIN[kind][codes[i]]
            tail.append(kind)
            kind = MOVE[kind][codes[i]]
        left.append(kind if i == 0 else base[0])
        added.append(total + whole - upto[i] + DELETE * extra)
        for path in paths:
            state = path[i]
            for j, k in zip(range(i, n), reversed(tail)):
                state = TO[k][codes[j]][state]
            ends.append(state)
    return left, added, ends


def trace(codes: bytes, kind: int, state: int, last: bool) -> tuple[list[str], str]:
    """Edits of every turn of a chunk and, behind the last turn of a conversation, the insertions that end it."""
    kinds, _ = backward(codes, kind)
    edits = []
    for i, c in enumerate(codes):
        e, state = CHOICE[kinds[i + 1]][c][state]
        edits.append(e)
    end = ""
    while last and state not in (START, ASSISTANT):
        end, state = end + "I", NEXT[state]
    return edits, end


# ---- turns -------------------------------------------------------------------------------------------------------------------

def key(c: Column) -> Column:
    """Conversation as text; null is one blank, which no number looks like."""
    return F.coalesce(c.cast("string"), F.lit(" "))


def _turns(df: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return df.select(key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                     digest.alias("digest"))


def _skeleton(turns: DataFrame) -> DataFrame:
    """One row for each (conversation, turn, digest) with its copies, kind of role and faults."""
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    rows = turns.select("conv", "turn", "digest", initial.alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("broken"))
    rows = rows.groupBy("conv", "turn", "digest", "initial", "blank", "broken").agg(F.count("*").alias("copies"))
    again = (rows.groupBy("conv", "digest").agg(F.min(F.struct("turn"))["turn"].alias("first"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    found = rows.join(again.withColumn("met", F.lit(True)), ["conv", "digest"], "left")
    repeated = F.coalesce(F.col("met") & ~F.col("turn").eqNullSafe(F.col("first")), F.lit(False))
    return found.select("conv", "turn", "digest", "initial", "blank", "broken", "copies", repeated.alias("repeated"))


_LONGS = ("turns", "blank", "duplicate", "truncated", "illegal", "numbers")
CHUNK_ROW = T.StructType([T.StructField(n, t) for n, t in (
    ("conv", T.StringType()), ("part", T.IntegerType()), ("seq", T.LongType()), ("codes", T.BinaryType()), ("extra", T.ArrayType(T.LongType())),
    ("turn", T.ArrayType(T.LongType())), ("digest", T.ArrayType(T.BinaryType())), *((n, T.LongType()) for n in _LONGS),
    ("first_kind", T.IntegerType()), ("last_kind", T.IntegerType()), ("least", T.LongType()), ("most", T.LongType()),
    ("left", T.ArrayType(T.IntegerType())), ("added", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.IntegerType())))])
#: Pairs of role initials that may follow each other: su, ua, au.
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _chunk(conv, part, seq, rows) -> dict:
    """One chunk from its distinct turns (turn, digest, initial, blank, broken, copies, repeated) in order."""
    codes, extra = bytearray(), []
    count = dict.fromkeys(_LONGS, 0)
    last_kind = last_turn = None
    for turn, _, kind, blank, broken, copies, repeated in rows:
        stays = not blank and not repeated
        codes.append(1 + 2 * kind + broken if stays else FORCED)
        extra.append(copies - 1)
        count["turns"] += copies
        count["blank"] += copies * blank
        count["duplicate"] += 0 if blank else copies - stays
        count["truncated"] += stays and broken
        count["illegal"] += copies - 1 + (last_kind is not None and (last_kind, kind) not in _LEGAL)
        count["numbers"] += turn is not None and turn != last_turn
        last_kind, last_turn = kind, turn
    numbers = [r[0] for r in rows if r[0] is not None]
    left, added, ends = speculate(bytes(codes), sum(extra))
    return {"conv": conv, "part": part, "seq": seq, "codes": bytes(codes), "extra": extra, "turn": [r[0] for r in rows], "digest": [r[1] for r in rows],
            **count, "first_kind": rows[0][2], "last_kind": last_kind, "least": numbers[0] if numbers else None, "most": numbers[-1] if numbers else None,
            "left": left, "added": added, "ends": ends}


def _chunks(skeleton: DataFrame, size: int) -> DataFrame:
    """Chunks of at most `size` distinct turns; a conversation may lie in several ranges."""
    names = ["turn", "digest", "initial", "blank", "broken", "copies", "repeated"]

    def run(batches) -> Iterator[dict]:
        conv, rows, part, seq = None, [], None, 0
        for c in batches:
            done, part = [], c["part"][0].as_py()
            keys = c["conv"].to_pylist()
            for k, row in zip(keys, zip(*(c[n].to_pylist() for n in names))):
                if rows and (k != conv or len(rows) == size):
                    done.append(_chunk(conv, part, seq, rows))
                    rows, seq = [], seq + 1
                conv = k
                rows.append(row)
            if done:
                yield {f.name: [d[f.name] for d in done] for f in CHUNK_ROW}
        if rows:
            yield {k: [v] for k, v in _chunk(conv, part, seq, rows).items()}
    spread = skeleton.repartitionByRange("conv", "turn", "digest").withColumn("part", F.spark_partition_id())
    return stash(arrow_map(spread.sortWithinPartitions("conv", "turn", "digest"), run, CHUNK_ROW))


def _rows_of(batches, names) -> Iterator[tuple]:
    for c in batches:
        yield from zip(*(c[n].to_pylist() for n in names))


def _stitch(chunks: DataFrame) -> DataFrame:
    """(conv, part, seq) -> kind of the true vector at the chunk's right end, state at its left end, cost from there, last."""
    names = ["conv", "part", "seq"]
    links = chunks.select(*names, "left", "added", "ends").repartition("conv")
    middle = T.StructType([*links.schema, T.StructField("kind", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("last", T.BooleanType())])
    result = T.StructType([*links.select(*names).schema, *middle.fields[-3:], T.StructField("state", T.IntegerType())])

    def leftwards(batches):
        conv = kind = least = None
        for c in batches:
            kinds, costs, last = [], [], []
            for k, left, added in zip(*(c[n].to_pylist() for n in ("conv", "left", "added"))):
                last.append(k != conv)
                if k != conv:
                    conv, kind, least = k, LAST, 0
                kinds.append(kind)
                least += added[kind]
                kind = left[kind]
                costs.append(least + KINDS[kind][START])          # of the whole conversation, at its first chunk
            yield c | {"kind": kinds, "cost": costs, "last": last}

    def rightwards(batches):
        conv = state = None
        for c in batches:
            states = []
            for k, kind, ends in zip(*(c[n].to_pylist() for n in ("conv", "kind", "ends"))):
                if k != conv:
                    conv, state = k, START
                states.append(state)
                state = ends[4 * kind + state]
            yield {n: c[n] for n in (*names, "kind", "cost", "last")} | {"state": states}
    back = arrow_map(links.sortWithinPartitions("conv", F.desc("part"), F.desc("seq")), leftwards, middle)
    return arrow_map(back.sortWithinPartitions("conv", "part", "seq"), rightwards, result)


EDIT = T.StructType([T.StructField(n, t) for n, t in (
    ("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("turn", T.LongType()), ("digest", T.BinaryType()))])


def _edits(chunks: DataFrame) -> DataFrame:
    """Chunks with the audit letters of their turns and the turns that are left or inserted, in order."""
    carried = ["conv", "part", "seq", *_LONGS, "first_kind", "last_kind", "least", "most", "cost"]
    target = T.StructType([*chunks.select(*carried).schema, T.StructField("audit", T.StringType()), T.StructField("edits", T.ArrayType(EDIT))])

    def run(batches):
        for c in batches:
            audits, out = [], []
            fields = ("codes", "extra", "turn", "digest", "kind", "state", "last")
            for codes, extra, turns, digests, kind, state, last in zip(*(c[n].to_pylist() for n in fields)):
                letters, end = trace(codes, kind, state, last)
                audit, rows = [], []
                for edits, more, turn, digest in zip([*letters, end], [*extra, 0], [*turns, None], [*digests, None]):
                    audit.append(edits + "D" * more)
                    for e in edits:
                        if e == "K":
                            rows.append((len(rows), e, None, turn, digest))
                            state = KEPT[(codes[len(audit) - 1] - 1) // 2][state]
                        elif e != "D":
                            state = NEXT[state]
                            rows.append((len(rows), e, NAMES[state], *((turn, digest) if e == "R" else (None, None))))
                audits.append("".join(audit))
                out.append([dict(zip(EDIT.fieldNames(), r)) for r in rows])
            yield {n: c[n] for n in carried} | {"audit": audits, "edits": out}
    return arrow_map(chunks.select(*carried, "codes", "extra", "turn", "digest", "kind", "state", "last"), run, target)


SUMMARY = T.StructType([T.StructField("conv", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        T.StructField("audit", T.StringType())])


def _summaries(edits: DataFrame) -> DataFrame:
    """One row a conversation: faults, cost and audit, folded over its chunks in order."""
    names = ["conv", "blank", "duplicate", "truncated", "illegal", "numbers", "first_kind", "last_kind", "least", "most", "cost", "audit"]

    def run(batches):
        conv = None

        def close():
            gaps = most - least + 1 - numbers if numbers else 0
            return dict(zip(SUMMARY.fieldNames(), (conv, gaps, *faults, cost, "".join(audit))))
        for c in batches:
            done = []
            for k, blank, dup, cut, illegal, n, first, last, lo, hi, price, letters in _rows_of([c], names):
                if k != conv:
                    if conv is not None:
                        done.append(close())
                    conv, faults, cost, audit, numbers, least, most, before = k, [0] * 4, price, [], 0, None, None, None
                crossed = before is not None and (before, first) not in _LEGAL
                faults = [a + b for a, b in zip(faults, (blank, dup, cut, illegal + crossed))]
                numbers += n - (n > 0 and lo == most)             # a turn number that two chunks share
                least, most = lo if least is None else least, hi if hi is not None else most
                before = last
                audit.append(letters)
            if done:
                yield {f: [d[f] for d in done] for f in SUMMARY.fieldNames()}
        if conv is not None:
            yield {f: [v] for f, v in close().items()}
    return arrow_map(edits.select("part", "seq", *names).repartition("conv").sortWithinPartitions("conv", "part", "seq"), run, SUMMARY)


class Repair(NamedTuple):
    #: (conv_id, conv, part, seq, place, edit, turn, role, text) of what is left; ordered by (part, seq, place) in a conversation.
    turns: DataFrame
    #: (conv_id, conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation.
    summary: DataFrame


def repair(df: DataFrame, conversations: DataFrame | None = None, chunk: int = CHUNK) -> Repair:
    """Repairs the rows (conv_id, turn, role, text); `conversations` may name more conv_id than have rows.

    Turns of a conversation stand by turn, nulls first, then by digest of role and text; equal rows are copies of one turn, of
    which the first may stay. A null role or text counts as one blank, a null conv_id as a conversation of its own. A turn
    without any character but blanks is blank; one whose role and text were met before is a duplicate; one whose last
    character that is no blank is not one of `.!?` is truncated; the first of these counts. Roles go by their initial; an
    empty one is like an unknown one. Other columns are left aside. An empty table gives empty results. A conversation
    without rows has zeros and an empty audit.
    """
    turns = _turns(df)
    chunks = _chunks(_skeleton(turns), chunk)
    edits = stash(_edits(chunks.join(_stitch(chunks), ["conv", "part", "seq"])))
    ids = (conversations if conversations is not None else df).select("conv_id").distinct().withColumn("conv", key(F.col("conv_id")))
    zero = {n: F.coalesce(n, F.lit(0)) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    summary = ids.join(_summaries(edits), "conv", "left").withColumns(zero | {"audit": F.coalesce("audit", F.lit(""))})
    left = edits.select("conv", "part", "seq", F.explode("edits").alias("e")).select("conv", "part", "seq", "e.*")
    # turns as text, so that the grouping and the join share one exchange of the texts
    texts = turns.groupBy("conv", key(F.col("turn")).alias("at"), "digest").agg(F.first("role").alias("own_role"), F.first("text").alias("text"))
    met = left.where("edit <> 'I'").withColumn("at", key(F.col("turn"))).join(texts, ["conv", "at", "digest"])
    names = ["conv", "part", "seq", "place", "edit", "turn", "role", "text"]
    rows = met.withColumn("role", F.coalesce("role", "own_role")).select(*names).unionByName(
        left.where("edit = 'I'").withColumn("text", F.lit("")).select(*names))
    conv_id = F.when(F.col("conv") != " ", F.col("conv")).cast(df.schema["conv_id"].dataType)
    return Repair(rows.select(conv_id.alias("conv_id"), *names), summary)


def text_digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of `role:text`, parted by newlines. A digest is sequential: a conversation's turns stream through one task."""
    target = T.StructType([T.StructField("conv", T.StringType()), T.StructField("sha256", T.StringType())])

    def run(batches):
        conv, state = None, None
        for c in batches:
            done = []
            for k, role, text in _rows_of([c], ["conv", "role", "text"]):
                if k != conv:
                    if conv is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield {"conv": [d[0] for d in done], "sha256": [d[1] for d in done]}
        if conv is not None:
            yield {"conv": [conv], "sha256": [state.hexdigest()]}
    ordered = turns.select("conv", "part", "seq", "place", "role", "text").repartition("conv").sortWithinPartitions("conv", "part", "seq", "place")
    return arrow_map(ordered, run, target)
