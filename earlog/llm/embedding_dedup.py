"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlog.llm.common import arrow_map, components, stash

#: Chance to miss a pair that lies exactly at the threshold, over all tables.
MISS = 1e-6
#: Vectors of one side that a task compares at once; larger buckets are compared block against block.
BLOCK = 1024


def plan(threshold: float, rows: int, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table and number of tables: about 64 unrelated vectors share a bucket, whatever the number of rows."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(6, math.ceil(math.log2(max(2, rows) / 64)))
    return bits, math.ceil(math.log(miss) / math.log1p(-agree ** bits))


def scaled(x: np.ndarray) -> np.ndarray:
    """Every row times a power of two, so that its largest magnitude lies in 0.5 to 1: squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def codes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Bucket of every row in every table: rows x tables."""
    planes = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], bits * tables))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def matrices(column) -> list[np.ndarray | None]:
    """Vectors in double precision; None for null, empty, zero and non-finite ones or ones with null components."""
    out = []
    for v in column.to_pylist():
        ok = v is not None and len(v) > 0 and None not in v
        a = np.array(v, float) if ok else None
        out.append(a if ok and np.isfinite(a).all() and a.any() else None)
    return out


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable by links, for every row of a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(linked)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def embedding_links(vectors: DataFrame, threshold: float = 0.95, miss: float = MISS, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors form a class at once and only one of a class is hashed. Every class goes to one bucket of each table;
    buckets above `block` are cut into blocks that meet pairwise, so no task holds a whole hot bucket and no pair of a
    group is written out: tasks return, per class, the number of linked vectors and one link to the smallest local class.
    A pair that meets in several tables counts in the first of them. Cosines are taken in double precision.

    Null, empty, zero and non-finite vectors, vectors with null components and rows without an id link with nothing; rows
    without an id have no component and stay. Repeated rows count as other vectors. Vectors of different lengths never link.
    """
    spark = vectors.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def classify(batches):
        for c in batches:
            ids, xs = c["vec_id"].to_pylist(), matrices(c["embedding"])
            raw = [None if x is None or i is None else (x + 0.0).tobytes() for i, x in zip(ids, xs)]
            yield {"vec_id": c["vec_id"], "x": raw}
    rows = stash(arrow_map(vectors.select("vec_id", "embedding"), classify, "vec_id bigint, x binary")
                 .withColumn("class", F.when(F.col("x").isNotNull(), F.md5("x"))))
    reps = stash(rows.where("x is not null").groupBy("class")
                 .agg(F.min(F.struct("vec_id", "x")).alias("m"), F.count("*").alias("size"))
                 .select(F.col("m.vec_id").alias("rep"), F.col("m.x").alias("x"), "size", "class"))
    bits, tables = plan(threshold, reps.count(), miss)

    def coded(c):
        xs = [np.frombuffer(b, float) for b in c["x"].to_pylist()]
        out = np.empty((len(xs), tables), np.int64)
        for d in {len(x) for x in xs}:
            at = [k for k, x in enumerate(xs) if len(x) == d]
            out[at] = codes(scaled(np.stack([xs[k] for k in at])), bits, tables, seed + d)
        return out, np.array([len(x) for x in xs])

    # Bucket sizes from ids alone; only buckets above a block matter afterwards.
    def light(batches):
        for c in batches:
            code, dim = coded(c)
            yield {"rep": np.repeat(c["rep"].to_numpy(), tables), "t": np.tile(np.arange(tables), len(code)),
                   "code": code.ravel(), "dim": np.repeat(dim, tables)}
    places = arrow_map(reps.select("rep", "x"), light, "rep bigint, t int, code bigint, dim int")
    sizes = stash(places.groupBy("t", "code", "dim").count().where(F.col("count") > block)
                  .withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count"))
    large = (places.join(sizes, ["t", "code", "dim"]).groupBy("rep")
             .agg(F.map_from_entries(F.collect_list(F.struct("t", "blocks"))).alias("blocks")))
    wide = reps.join(large, "rep", "left").select("rep", "x", "size", "blocks")

    def deal(batches):
        for c in batches:
            code, dim = coded(c)
            reps_, xs, size = c["rep"].to_pylist(), c["x"].to_pylist(), c["size"].to_pylist()
            out = {k: [] for k in ("t", "code", "dim", "i", "j", "side", "rep", "x", "size", "codes")}
            for k, more in enumerate(c["blocks"].to_pylist()):
                more, packed = dict(more or []), code[k].astype("<u4").tobytes()
                for t in range(tables):
                    nb = more.get(t, 1)
                    own = (reps_[k] * 2654435761 + t >> 7) % nb
                    for other in range(nb):
                        row = (t, int(code[k, t]), int(dim[k]), min(own, other), max(own, other), own, reps_[k], xs[k], size[k], packed)
                        for n, v in zip(out, row):
                            out[n].append(v)
                if len(out["t"]) > 4000:
                    yield out
                    out = {k: [] for k in out}
            yield out
    key = ["t", "code", "dim", "i", "j"]
    dealt = (arrow_map(wide, deal, "t int, code bigint, dim int, i int, j int, side int, rep bigint, x binary, size bigint, codes binary")
             .repartition(n_parts, *key).sortWithinPartitions(*key))

    def compare(rows):
        same = rows[0][3] == rows[0][4]
        x = scaled(np.stack([np.frombuffer(r[7], float) for r in rows]))
        x = x / np.sqrt((x * x).sum(1))[:, None]
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if not same:
            side = np.array([r[5] for r in rows])
            near &= side[:, None] != side[None]
        if not near.any():
            return None
        rep, size, t = np.array([r[6] for r in rows]), np.array([r[8] for r in rows]), rows[0][0]
        before = np.stack([np.frombuffer(r[9], "<u4")[:t] for r in rows])
        first = near.copy()
        for k in range(t):
            first &= before[:, k][:, None] != before[:, k][None]
        at = np.flatnonzero(near.any(1))
        return rep[at], (first * size[None]).sum(1)[at], rep[at][local_roots(near[np.ix_(at, at)])]

    def search(batches):
        names = (*key, "side", "rep", "x", "size", "codes")
        held, group = [], None

        def emit():
            found = compare(held) if len(held) > 1 else None
            if found is not None:
                yield dict(zip(("rep", "n", "root"), found))
        for c in batches:
            for r in zip(*(c[n].to_pylist() for n in names)):
                if r[:5] != group:
                    yield from emit()
                    held, group = [], r[:5]
                held.append(r)
        yield from emit()
    found = stash(arrow_map(dealt, search, "rep bigint, n bigint, root bigint"))
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = stash(reps.select("rep", "class", "size").join(linked, "rep", "left")
                    .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                    .select("class", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                            F.coalesce("component", "rep").alias("component_id")))
    return (rows.select("vec_id", "class").join(classes, "class", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"),
                    F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept")))
