import random
from collections import defaultdict

from earlog.llm import line_dedup as ld
from earlog.llm.queries import op9_lines


def brute(rows, least):
    """Marks every run with enough words that has an earlier copy, all lengths tried."""
    first, gone = {}, defaultdict(set)
    for d, t in rows:
        ls = t.split("\n")
        for a in range(len(ls)):
            words = 0
            for b in range(a, len(ls)):
                words += len(ls[b].split())
                if words < least:
                    continue
                run = tuple(ls[a:b + 1])
                if run in first and first[run] != (d, a):
                    gone[d].update(range(a, b + 1))
                elif run not in first:
                    first[run] = (d, a)
                else:
                    break
                if b - a > 40:
                    break
    return gone


def left(rows, least):
    gone = brute(rows, least)
    return {d: (len(gone[d]), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) if gone[d] else t) for d, t in rows}


def crafted():
    rng = random.Random(8)
    lines = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 7))) for _ in range(6)] + ["", "solo line with many words " * 3]
    return [(i, "\n".join(rng.choice(lines) if rng.random() < .9 else f"unique {i} {k} line" for k in range(rng.randrange(1, 25)))) for i in range(60)]


def test_crafted(spark):
    rows = crafted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 10, 30):
        got = {r["doc_id"]: (r["deleted_lines"], r["text"]) for r in ld.line_dedup(df, least).collect()}
        assert got == left(rows, least), least


def test_shortest_runs():
    import numpy as np
    a, b = ld.shortest_runs(np.array([0, 3, 0, 4, 1]), 4)
    assert a.tolist() == [4, 3, 2, 1, 0] and b.tolist() == [0, 0, 0, 1, 2]


def test_query(spark, sf, docs):
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    want = left(rows, ld.MIN_WORDS)
    got = {r["doc_id"]: (r["deleted_lines"], r["kept_chars"]) for r in op9_lines(spark, sf).collect()}
    assert got == {d: (n, len(t)) for d, (n, t) in want.items()} and any(n for n, _ in got.values())


def test_odd(spark, odd_docs):
    out = ld.line_dedup(odd_docs, 10)
    assert out.columns == odd_docs.columns + ["deleted_lines"] and out.count() == odd_docs.count()
    by = defaultdict(list)
    for r in out.collect():
        by[r["doc_id"]].append((r["deleted_lines"], r["text"]))
    assert by[0] == [(0, None)] and by[1] == [(0, "")] and by[3][0][0] == 0 and by[4] == [(3000, "")] * 2
    assert by[5] == [(0, by[5][0][1])] * 2 and (1, "") in by[6] and len(by[None]) == 2
    assert ld.line_dedup(odd_docs.limit(0)).count() == 0


def test_clashing_names(spark):
    same = "\n".join(f"line {k} with some words in it" for k in range(9))
    df = spark.createDataFrame([(1, same, 7, 8, "x", "y", "z", "b"), (2, same, 1, 2, "p", "q", "r", "s")],
                               "doc_id long, text string, _k int, _t int, _d string, _H string, _gone string, `a``b` string")
    out = ld.line_dedup(df, 10)
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert out.columns == df.columns + ["deleted_lines"]
    assert got == {1: (1, same, 7, 8, "x", "y", "z", "b", 0), 2: (2, "", 1, 2, "p", "q", "r", "s", 9)}
