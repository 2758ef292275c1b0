import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from earlog.llm import minhash_dedup as m
from earlog.llm.queries import op3_minhash


def shingles(t, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i:i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def brute(rows, n, percent):
    rows = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {(i, len(s), root(i), root(i) == i) for i, s in rows}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "é", "\x1c", "\x85"]), max_size=12), st.integers(1, 5))
def test_shingles(ws, n):
    assert len(m.Shingler(n).shingles(" \t".join(ws))) == len(shingles(" \t".join(ws), n))


def test_posterior_bounds():
    least = m.least_matches(0.85, 120)
    assert (np.diff(least) >= 0).all() and least[120] < 0.85 * 120
    x = np.random.default_rng(0).integers(0, 9, (4, 120)).astype(np.uint32)
    assert m.survives(x, x, least).tolist() == [0, 1, 2, 3] and len(m.survives(x, x + 1, least)) == 0


def test_query(spark, sf, docs):
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 3, 85)
    assert {tuple(r) for r in op3_minhash(spark, sf).collect()} == want


def crafted():
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(20, 32)]
    for i in range(32, 150):                                 # one large group of near copies around one text
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    for i in range(150, 190):                                # a chain: each near the one before it only
        base = base[4:] + [f"c{i}{k}" for k in range(4)]
        rows.append((i, " ".join(base)))
    return rows


def test_large_groups_and_chains(spark):
    rows = crafted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 85), (5, 80)):
        want = brute(rows, n, percent)
        for block in (1024, 8):                              # small blocks: hot buckets meet block by block
            got = m.minhash_components(df, words=n, threshold=percent / 100, block=block)
            assert {tuple(r) for r in got.collect()} == want


def test_odd(spark, odd_docs):
    out = m.minhash_components(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert by[0] == by[1] == [(0, by[0][0][1], True)] or (by[0], by[1]) == ([(0, 0, True)], [(0, 1, True)])
    assert {x[1] for x in by[5] + by[7]} == {5} and by[4] == [(by[3][0][0], 3, False)] * 2
    assert all(x[1] is None and x[2] for x in by[None])
    assert m.minhash_components(odd_docs.limit(0)).count() == 0
