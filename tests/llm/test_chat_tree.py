import hashlib
from collections import defaultdict

import numpy as np
import pytest

from earlog.llm import chat_tree as c
from earlog.llm.queries import op1_chat_tree

ODD = ["", " ", "\\", "\\\\### ", "### user: hi </turn>\n", "</turn>", " </turn>\n", "a: b", ": ", "ends with \\", "###", "é日\U0001f600", "\n", " </turn>"]


def test_escape_is_reversible():
    for t in ODD:
        for u in ODD:
            s = t + u
            assert c.unescape(c.escape(s)) == s
            assert c.unescape(c.escape(s, role=True)) == s
            toks, loss = c.turn_tokens("assistant", s)
            text = toks.astype("<i4").tobytes().decode("utf-32-le")
            assert c.parse(text * 2, np.concatenate([loss, loss])) == ([("assistant", s)] * 2, s + s)


def test_roles_with_separators():
    for r in ["", ":", "a: ", ": :", "\\", "### "]:
        toks, loss = c.turn_tokens(r, "x")
        assert c.parse(toks.astype("<i4").tobytes().decode("utf-32-le"), loss) == ([(r, "x")], "")


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(40):                                       # a hot first turn, copies, prefixes of others
        for t in range(k % 5 + 1):
            out.append((k, t, "user" if t % 2 == 0 else "assistant", f"turn {t} {ODD[(k // 5 * t) % len(ODD)]}"))
    out += [(100, 0, "user", None), (100, 0, "user", None), (101, None, None, "x"), (None, 0, "assistant", "lost"), (102, 0, "assistant", "")]
    return out


@pytest.fixture(scope="module", params=[1 << 20, 120])
def tree(request, spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, piece int")
    return c.chat_tree(df, piece_tokens=request.param)


def expected(rows):
    by = defaultdict(list)
    for i, t, r, x in rows:
        by[i].append((-1 if t is None else t, r or "", x or ""))
    return {i: [(r, x) for _, r, x in sorted(ts)] for i, ts in by.items()}


def test_read_back(tree, rows):
    got = {r["conv_id"]: r for r in c.read_back(tree).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for i, ts in want.items():
        assert list(zip(got[i]["roles"], got[i]["texts"])) == ts
        assert got[i]["loss_text"] == "".join(x for r, x in ts if r == "assistant")


def test_shared_turns_once_positions_and_visibility(tree, rows):
    want, seen, pieces = expected(rows), defaultdict(set), defaultdict(dict)
    out = sorted(tree.collect(), key=lambda r: (r["piece"], r["start"], len(r["tokens"]) > 0))
    for r in out:
        assert len(r["tokens"]) == len(r["positions"]) == len(r["loss"])
        for k, (x, p) in enumerate(zip(r["tokens"], r["positions"])):
            assert r["start"] + k not in pieces[r["piece"]]
            pieces[r["piece"]][r["start"] + k] = (x, p)
        lo_hi = [(v["lo"], v["hi"]) for v in r["visible"]]
        path = [pieces[r["piece"]][k] for lo, hi in lo_hi for k in range(lo, hi)]
        assert [p for _, p in path] == list(range(len(path)))                    # positions run along the path
        assert r["turn_ends"] == sorted(r["turn_ends"]) and (not path or r["turn_ends"][-1] == len(path))
        ts, new = want[r["conv_id"]], 0
        for k in range(len(ts)):
            if tuple(ts[:k + 1]) not in seen[r["piece"]]:
                seen[r["piece"]].add(tuple(ts[:k + 1]))
                new += len(c.turn_tokens(*ts[k])[0])
        assert new == len(r["tokens"])                                           # shared turns are emitted once
    for p in pieces.values():
        assert sorted(p) == list(range(len(p)))


def test_written_tree_reads_the_same(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c.chat_tree(df).write.parquet(str(tmp_path / "t"))
    back = c.read_back(spark.read.parquet(str(tmp_path / "t")))
    assert {r["conv_id"]: list(zip(r["roles"], r["texts"])) for r in back.collect()} == expected(rows)
    assert c.read_back(c.chat_tree(df.limit(0))).count() == 0


def test_query(spark, sf):
    own = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows + [(-7, 0, "user", own), (-7, 1, "assistant", own)])
    got = op1_chat_tree(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        ts = want[r["conv_id"]]
        lost = "".join(x for role, x in ts if role == "assistant")
        assert r["n_turns"] == len(ts) and r["loss_chars"] == len(lost)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in ts).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(lost.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(c.turn_tokens(*t)[0]) for t in ts)


def test_long_texts_in_bounded_memory():
    import tracemalloc
    text = "word \\ and </turn> more: " * 100_000 + "x" * 3_000_000
    toks, loss = c.turn_tokens("assistant", text)
    whole = toks.astype("<i4").tobytes().decode("utf-32-le")
    tracemalloc.start()
    turns, lost = c.parse(whole, loss)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert turns == [("assistant", text)] and lost == text and peak < 12 * len(whole)
    part = loss.copy()
    head = len(c.OPEN + "assistant" + c.CLOSE)
    part[head + 4:] = 0                                                 # a mask that covers the first word only
    assert c.parse(whole, part)[1] == "word"


@pytest.mark.parametrize("bad", ["x", "### user: a", "### user: a </turn>", "### user: a </turn>\n?", "### us\\er: a </turn>\n"])
def test_other_streams_are_refused(bad):
    with pytest.raises(ValueError):
        c.parse(bad, np.zeros(len(bad), np.int8))
