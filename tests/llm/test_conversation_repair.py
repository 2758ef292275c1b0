import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from earlog.llm import conversation_repair as cr
from earlog.llm.queries import damaged, op13_repair

BLANK = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def harm(rows):
    """The damage of the query, row by row."""
    out = []
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """Rows of one conversation -> result columns; edits by plain recursion over whole audit strings."""
    rows = sorted(((t is not None, t or 0, digest(r, x)), t, r, x) for _, t, r, x in ((a, b, *(" " if v is None else v for v in (c, d))) for a, b, c, d in rows))
    seen, faults = set(), []
    for _, _, r, x in rows:
        body = BLANK.sub("", x)
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserted=0):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            new = legal[state][-1]
            cost, audit, kept = best(i, new, inserted + 1)
            ways.append((cost + 2, "I" + audit, (("user:" if new == "u" else "assistant:"), *kept)))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, kept = best(i + 1, state)
            ways.append((cost + 3, "D" + audit, kept))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] and role[:1] in legal[state]:
                    cost, audit, kept = best(i + 1, role[0])
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}", *kept)))
                for name in ("user", "assistant"):
                    if name[0] in legal[state]:
                        cost, audit, kept = best(i + 1, name[0])
                        ways.append((cost + 2 + more, "R" + audit, (f"{name}:{text}", *kept)))
        return min(ways, key=lambda w: w[:2]) if ways else (10 ** 6, "", ())
    cost, audit, kept = best(0, "")
    assert re.fullmatch("(s?(ua)+)?", "".join(k[0] for k in kept))
    numbers = [t for _, t, _, _ in rows if t is not None]
    letters = [r[:1] for _, _, r, _ in rows]
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest())


def random_conversations(rng, n, most):
    texts = ["yes.", "no!", "why?", "well", "", " \t", "ok. ", "so.  ", "é", "\x1c.", None, "a.b", "long text without an end"]
    roles = ["user", "assistant", "system", "u", "s", "bot", "", None, "Assistant"]
    rows = []
    for c in range(n):
        some = rng.choice([roles[:2], roles[:3], roles, roles[5:], roles[:1], roles[2:3]])
        own = rng.choice([texts, texts[:3], [f"t{k}." for k in range(9)], [f"t{k}" + "." * (k % 2) for k in range(40)]])
        rows += [(c, rng.choice([None, k, k, k, k // 2 * 5, -k]), rng.choice(some), rng.choice(own)) for k in range(rng.randrange(1, most))]
    return rows


def result(fixed):
    rows = {r["conv"]: r["sha256"] for r in cr.text_digests(fixed.turns).collect()}
    return {r["conv_id"]: (*(r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")),
                           rows.get(r["conv"], hashlib.sha256(b"").hexdigest())) for r in fixed.summary.collect()}


def wanted(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return {c: brute(tuple(rs)) for c, rs in by.items()}


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_random(spark, chunk):
    rows = random_conversations(random.Random(chunk), 70, 13)
    rows += [(None, *r[1:]) for r in rows[:9]]
    assert result(cr.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk=chunk)) == wanted(rows)


def test_hot_conversation(spark):
    """One conversation in many ranges and chunks; sequences whose ranks fall at once, late and never."""
    rng = random.Random(3)
    kinds = [lambda k: ("user", "assistant")[k % 2], lambda k: "bot", lambda k: rng.choice(["user", "assistant"]), lambda k: "user"]
    for kind in kinds:
        rows = [(1, k, kind(k), f"text {k if k % 7 else 0}" + "." * (k % 3)) for k in range(400)] + [(2, 0, "user", "a."), (3, 1, "x", "b.")]
        rows += [(1, 5, "user", "same.")] * 50
        got = result(cr.repair(spark.createDataFrame(rows, SCHEMA).repartition(6), chunk=16))
        sys.setrecursionlimit(10_000)
        assert got == wanted(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in op13_repair(spark, sf).collect()}
    want = wanted(harm(rows))
    none = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, none) for c in {r[0] for r in rows}}
    assert any(v[5] for v in got.values())


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, -3) for t in (None, *range(30)) for r, x in ((None, "a.b!"), ("assistant", None), ("system", "x?"))]
    got = sorted(map(repr, (tuple(r) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == sorted(map(repr, harm(rows)))


def test_costs_behind_any_border():
    """Summaries of chunks say what a run over the whole sequence says, whatever comes in from the right."""
    rng = random.Random(9)
    for n in (0, 1, 2, 5, 40):
        for pool in (range(cr.CODES), (7, 8), (0,), (3, 5), (0, 7)):
            codes = bytes(rng.choice(pool) for _ in range(n))
            left, added, ends = cr.speculate(codes, 2)
            for kind in range(len(cr.KINDS)):
                kinds, total = cr.backward(codes, kind)
                assert (left[kind], added[kind]) == (kinds[0], total + 6)
                for state in range(4):
                    s = state
                    for i, c in enumerate(codes):
                        s = cr.TO[kinds[i + 1]][c][s]
                    assert ends[4 * kind + state] == s


def test_family_is_closed():
    assert len(cr.KINDS) == 16 and all(0 <= k < 16 for row in cr.MOVE for k in row) and all(min(v) == 0 for v in cr.KINDS)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "hi."), (1, 2, "user", " ")]
    fixed = cr.repair(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r) for r in fixed.turns.orderBy("part", "seq", "place").select("edit", "role", "text").collect()]
    assert fixed.summary.first()["audit"] == "KIKD" and got == [("K", "system", "s."), ("I", "user", ""), ("K", "assistant", "hi.")]


def test_odd(spark):
    rows = [(1, 0, "user", "long. " * 100_000), (1, 1, "assistant", "y" * 300_000 + "."), (None, None, None, None), (None, None, None, None),
            (2, None, "user", ""), (4, 2 ** 62, "user", "a."), (4, -2 ** 62, "assistant", "b.")]
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA + ", part int, conv string, `a``b` string")
    got = result(cr.repair(df))
    assert got == wanted(rows) and got[None][:3] == (0, 2, 0) and got[2][6] == "D"
    empty = cr.repair(df.limit(0))
    assert empty.summary.count() == 0 and empty.turns.count() == 0
    more = cr.repair(df.limit(0), df).summary.collect()
    assert {(r["conv_id"], r["cost"], r["audit"]) for r in more} == {(1, 0, ""), (2, 0, ""), (4, 0, ""), (None, 0, "")}
