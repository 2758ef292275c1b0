import itertools

import numpy as np

from earlog.llm import embedding_dedup as e
from earlog.llm.queries import op8_embeddings


def brute(rows, threshold=0.95):
    x = [None if i is None or v is None or not len(v) or None in v or not np.isfinite(np.array(v, float)).all() or not np.any(v) else np.array(v, float)
         for i, v in rows]
    n, up = [0] * len(rows), {i: i for i, _ in rows if i is not None}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a
    for a, b in itertools.combinations(range(len(rows)), 2):
        if x[a] is None or x[b] is None or len(x[a]) != len(x[b]) or x[a] @ x[b] / np.sqrt(x[a] @ x[a]) / np.sqrt(x[b] @ x[b]) < threshold:
            continue
        n[a] += 1
        n[b] += 1
        p, q = sorted((root(rows[a][0]), root(rows[b][0])))
        up[q] = p
    return sorted(((i, k, None if i is None else root(i), i is None or root(i) == i) for (i, _), k in zip(rows, n)), key=repr)


def test_query(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in op8_embeddings(spark, sf).collect()), key=repr) == brute(rows)


def test_odd_and_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * .12).tolist()) for i in range(120)]                       # one large loose group
    rows += [(i, base.tolist()) for i in range(200, 260)] + [(200, base.tolist())] * 3                  # copies and repeated rows
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] + [1.0] * 15), (304, [None] + [1.0] * 15), (305, [float("inf")] * 16),
             (None, base.tolist()), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, (2 * base).tolist()), (309, (-base).tolist()), (310, [-0.0, 1.0]), (311, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, None, "c") for i, v in rows], "vec_id long, embedding array<double>, label int, class string")
    for block in (1024, 7):
        got = e.embedding_links(df, block=block).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert e.embedding_links(df.limit(0)).count() == 0


def test_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base * s).tolist()) for i, s in enumerate([1.0, 1e200, 1e-200, 1e300, 5e-324 / 1e-10, -1e200])] + [(10, (rng.normal(size=8) * 1e250).tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 5: (0, 5), 10: (0, 10)}
