"""Harmonic-mixing partners: related keys and fitting tempo."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from earlog import config as C
from earlog.functions import keys as K
from earlog.functions.columns import artist, col, rounded
from earlog.functions.ship import by_value
from earlog.operators import base
from earlog.session import ensure_checkpoint_dir

by_value(__name__)

_FACTORS = (1.0, 2.0, 0.5)


def candidates(features: DataFrame, tracks: DataFrame, conf: float = C.MIX_KEY_CONF) -> DataFrame:
    """Audio rows with a confident, readable key and a tempo."""
    rows = features.filter((F.col("source") == "audio") & (F.col("mode_conf") >= conf) & (F.col("tempo") > 0))
    rows = rows.withColumn("_code", K.wheel_code("key")).filter(F.col("_code").isNotNull())
    return base.semi(rows.select("track_id", "key", "tempo", F.col("_code.num").alias("num"),
                                 F.col("_code.letter").alias("letter")), tracks.select("track_id"))


def tempo_nodes(rows: DataFrame, n: int) -> DataFrame:
    """One node per (key code, tempo): item count and the n + 1 smallest ids.

    Everything that decides a match is a function of the node, so copies collapse here.
    """
    counts = rows.groupBy("num", "letter", "tempo").agg(F.count(F.lit(1)).alias("cnt"))
    some = base.first_k(rows, ["num", "letter", "tempo"], [F.col("track_id")], n + 1)
    ids = some.groupBy("num", "letter", "tempo").agg(F.sort_array(F.collect_list(F.struct("track_id", "key"))).alias("ids"))
    return counts.join(ids, ["num", "letter", "tempo"])


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def _window(tempo: pd.Series, factor: pd.Series, tolerance: pd.Series) -> pd.DataFrame:
    """Least and greatest tempo whose deviation, as it is computed, is within the tolerance."""
    t, f, tol = (np.asarray(v, float) for v in (tempo, factor, tolerance))
    out = {}
    for name, sign in (("lo", -1.0), ("hi", 1.0)):
        x = t * f * (1 + sign * tol)
        for _ in range(16):                                      # a few neighbouring doubles decide
            outer = np.nextafter(x, sign * np.inf)
            x = np.where(np.abs((outer / t - f) / f) <= tol, outer, x)
        for _ in range(16):
            x = np.where(np.abs((x / t - f) / f) > tol, np.nextafter(x, -sign * np.inf), x)
        out[name] = x
    return pd.DataFrame(out)


LOW, NODE, HIGH, CENTRE, EDGE = range(5)
_SWEPT = ("part int, code int, kind int, s_code int, s_tempo double, rel int, lo double, hi double, before bigint, "
          "near array<double>, near_n array<bigint>, open_left boolean, open_right boolean, first array<struct<tempo:double,cnt:bigint>>, "
          "last array<struct<tempo:double,cnt:bigint>>")


def _events(nodes: DataFrame, tolerance: float) -> DataFrame:
    """Nodes and what is asked about them, on one line for each key code: bounds of a tempo window and its centre."""
    factors = F.array(*[F.lit(f) for f in _FACTORS])
    asked = nodes.select("code", "tempo", F.explode(K.compatible_codes(F.struct("num", "letter"))).alias("c")).select(
        F.col("code").alias("s_code"), F.col("tempo").alias("s_tempo"), F.col("c.rank").alias("rel"), _code("c.num", "c.letter").alias("code"),
        F.explode(factors).alias("f")).withColumn("w", _window("s_tempo", "f", F.lit(tolerance)))
    points = F.array(*[F.struct(F.lit(kind).alias("kind"), pos.alias("pos")) for kind, pos in (
        (LOW, F.col("w.lo")), (HIGH, F.col("w.hi")), (CENTRE, F.col("s_tempo") * F.col("f")))])
    asked = asked.withColumn("p", F.explode(points)).select(
        "code", "p.pos", "p.kind", F.lit(0).cast("bigint").alias("cnt"), "s_code", "s_tempo", "rel", "w.lo", "w.hi")
    return nodes.select("code", F.col("tempo").alias("pos"), F.lit(NODE).alias("kind"), "cnt").unionByName(asked, allowMissingColumns=True)


def _sweep(n: int):
    """Answers of one range of the line: nodes counted before each bound, nearest nodes beside each centre, and the range's ends."""
    names = [c.split(" ")[0] for c in _SWEPT.split(", ")]
    pair = pa.struct([("tempo", pa.float64()), ("cnt", pa.int64())])
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()),
             pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.list_(pair), pa.list_(pair)]

    def beside(at, step, tempo, cnt, inside):
        """Nodes from `at` outwards while they are inside the window and fewer than n + 1 items are taken; did the range end first?"""
        picks, taken = np.full((len(at), n + 1), -1), np.zeros(len(at), np.int64)
        going, cut = np.ones(len(at), bool), np.zeros(len(at), bool)
        for j in range(n + 1):
            i = at + step * j
            going &= taken <= n
            there = (i >= 0) & (i < len(tempo))
            cut |= going & ~there
            going &= there
            if not going.any():
                break
            i = np.where(going, i, 0)
            going &= inside(tempo[i])
            picks[going, j] = i[going]
            taken[going] += cnt[i[going]]
        return picks, cut

    def segment(part, code, g):
        node = g["kind"] == NODE
        tempo, cnt = g["pos"][node], g["cnt"][node]
        passed = np.cumsum(node) - node
        total = np.concatenate([[0], np.cumsum(cnt)])
        ask = np.flatnonzero(~node)
        kind, at = g["kind"][ask], passed[ask]
        near, near_n = [None] * len(ask), [None] * len(ask)
        left, right = np.zeros(len(ask), bool), np.zeros(len(ask), bool)
        c = np.flatnonzero(kind == CENTRE)
        if len(c):
            lo, hi = g["lo"][ask][c], g["hi"][ask][c]
            before, left[c] = beside(at[c] - 1, -1, tempo, cnt, lambda t: t >= lo)
            after, right[c] = beside(at[c], 1, tempo, cnt, lambda t: t <= hi)
            both = np.concatenate([before, after], 1)
            for k, row in zip(c.tolist(), both):
                row = row[row >= 0]
                near[k], near_n[k] = tempo[row], cnt[row]
        m = len(ask)
        ends = [{"tempo": t, "cnt": k} for t, k in zip(tempo.tolist(), cnt.tolist())]
        cols = {"part": [part] * (m + 1), "code": [code] * (m + 1), "kind": [*kind.tolist(), EDGE], "before": [*total[at].tolist(), int(total[-1])],
                "near": [*near, None], "near_n": [*near_n, None], "open_left": [*left.tolist(), None], "open_right": [*right.tolist(), None],
                "first": [None] * m + [ends[:n + 1]], "last": [None] * m + [ends[::-1][:n + 1]]}
        cols |= {c: [*g[c][ask].tolist(), None] for c in ("s_code", "s_tempo", "rel", "lo", "hi")}
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in zip(names, types)], names=names)

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        g = {c: whole[c].to_numpy() for c in whole.schema.names}
        edges = [0, *(np.flatnonzero(np.diff(g["code"])) + 1).tolist(), whole.num_rows]
        for a, z in zip(edges, edges[1:]):
            yield segment(int(g["part"][0]), int(g["code"][a]), {c: v[a:z] for c, v in g.items()})
    return run


def _code(num: Column | str, letter: Column | str) -> Column:
    return (col(num) * 2 + F.when(col(letter) == "B", 1).otherwise(0)).cast("int")


def nearest_nodes(nodes: DataFrame, tolerance: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Matches of every node: those that hold the n + 1 nearest items of each relation, and the number of items of all of them.

    One sweep over lines sorted by (key code, tempo), cut into ranges, so work and rows grow with the nodes however close their
    tempi are. What a centre or a bound misses beyond its range is added from the ends and counts of the ranges beside it.
    """
    if not 0 < tolerance < 1 / 3:
        raise ValueError("tempo windows of 1x, 2x and half tempo overlap from a tolerance of one third on")
    ensure_checkpoint_dir(nodes.sparkSession)
    events = _events(nodes.withColumn("code", _code("num", "letter")), tolerance)
    line = ["code", "pos", "kind"]
    ranges = events.repartitionByRange(*[F.col(c) for c in line]).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*line)
    swept = ranges.mapInArrow(_sweep(n), _SWEPT).checkpoint()
    beside = Window.partitionBy("code").orderBy("part")          # at most one row for each range
    earlier, later = beside.rowsBetween(Window.unboundedPreceding, -1), beside.rowsBetween(1, Window.unboundedFollowing)
    ends = swept.where(F.col("kind") == EDGE).select(
        "part", "code", F.coalesce(F.sum("before").over(earlier), F.lit(0)).alias("offset"),
        F.slice(F.flatten(F.reverse(F.collect_list("last").over(earlier))), 1, n + 1).alias("e_left"),
        F.slice(F.flatten(F.collect_list("first").over(later)), 1, n + 1).alias("e_right"))
    asked = swept.where(F.col("kind") != EDGE).drop("first", "last").join(ends, ["part", "code"])
    seed = ["s_code", "s_tempo"]
    count = F.col("before") + F.col("offset")
    totals = asked.where(F.col("kind") != CENTRE).groupBy(*seed).agg(
        (F.sum(F.when(F.col("kind") == HIGH, count).otherwise(-count)) - 1).alias("total"))
    own = F.zip_with("near", "near_n", lambda t, k: F.struct(t.alias("tempo"), k.alias("cnt")))
    none = F.array().cast("array<struct<tempo:double,cnt:bigint>>")
    more = [F.when(F.col("open_left"), F.filter("e_left", lambda e: e["tempo"] >= F.col("lo"))).otherwise(none),
            F.when(F.col("open_right"), F.filter("e_right", lambda e: e["tempo"] <= F.col("hi"))).otherwise(none)]
    pairs = asked.where(F.col("kind") == CENTRE).select(*seed, "rel", "code", F.explode(F.concat(own, *more)).alias("e"))
    pairs = pairs.select(*seed, "rel", "code", "e.tempo", "e.cnt", K.tempo_delta(F.col("s_tempo"), F.col("e.tempo"), tolerance).alias("delta"))
    return pairs, totals


def mixable(features: DataFrame, tracks: DataFrame, conf: float = C.MIX_KEY_CONF, n: int = 12,
            tolerance: float = C.TEMPO_TOLERANCE) -> DataFrame:
    """Best n partners of every eligible item and the number of all its partners.

    Order: same key, one step up, one step down, relative key; then the smaller tempo deviation; id.
    Work is done per node: a sweep finds the nodes with the n + 1 nearest items of each relation, a running count cuts them
    before any item id is expanded, so no seed meets all items of its group.
    """
    rows = candidates(features, tracks, conf).withColumn("code", _code("num", "letter"))
    nodes = tempo_nodes(rows, n)
    pairs, totals = nearest_nodes(nodes.drop("ids"), tolerance, n)
    seed = ["s_code", "s_tempo"]
    pairs = pairs.withColumn("_abs", F.abs("delta"))
    w = Window.partitionBy(*seed).orderBy("rel", "_abs")
    before = F.sum("cnt").over(w) - F.sum("cnt").over(Window.partitionBy(*seed, "rel", "_abs"))
    near = pairs.withColumn("_before", before).filter(F.col("_before") <= n).join(
        nodes.select(_code("num", "letter").alias("code"), "num", "letter", "tempo", "ids"), ["code", "tempo"])
    best = base.first_k(near.select(*seed, "rel", "delta", "_abs", "num", "letter", "tempo", F.explode("ids").alias("o")),
                        seed, [F.col("rel"), F.col("_abs"), F.col("o.track_id")], n + 1)
    lists = best.groupBy(*seed).agg(F.sort_array(F.collect_list(F.struct(
        "rel", "_abs", F.col("o.track_id").alias("track_id"), F.col("o.key").alias("key"), "delta", "num", "letter",
        "tempo"))).alias("xs")).join(totals, seed)
    names = F.array(*[F.lit(r) for r in K.RELATIONS])
    on = [rows.code == lists.s_code, rows.tempo == lists.s_tempo]
    own = rows.join(lists, on).select(
        rows.track_id.alias("seed"), "total",
        F.posexplode(F.slice(F.filter("xs", lambda x: x["track_id"] != rows.track_id), 1, n)).alias("i", "x"))
    return own.select(
        "seed", (F.col("i") + 1).alias("rank"), F.col("x.track_id").alias("track_id"), F.col("x.key").alias("key"),
        K.code_text(F.col("x")).alias("wheel"), rounded("x.tempo", 1).alias("tempo"),
        rounded("x.delta", 3).alias("tempo_delta"), names[F.col("x.rel")].alias("relation"), "total")


def describe(pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds title, channel, artist and plays of the partner."""
    return pairs.join(tracks.select("track_id", "title", "channel", artist().alias("artist"), "play_count"), "track_id")
