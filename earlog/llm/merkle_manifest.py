"""Merkle manifest of a dataset with a proof for every row, built from incremental witnesses.

Leaves of a group stand in a fixed order and are appended, in order, to blocks that are aligned to a power of the fan-out.
A task streams one block at a time: a leaf joins the open run of siblings, and that run is its witness as far as it is known;
each later sibling that completes extends the run, and so the witness of everything already below it. A full run is hashed and
appended to the open run above. Finished block roots are rows again and are appended to blocks of blocks, in ever fewer rows,
until each group has one root; group roots are appended in the same way. Witnesses of the upper rounds are joined to the blocks
below, round by round: one join on (group, block), a bounded number of rows for each key.

Digests are lowercase hex of SHA-256 over concatenated inputs. Leaves are hashed by Spark's own functions where the text lies;
texts are never shuffled.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earlog.llm.common import arrow_map, stash

FAN_OUT = 16
#: Levels of the tree that one block spans: 16 ** 3 leaves.
LEVELS = 3
#: Ways in which the rows of one group meet the one row of their group's place among all groups.
SALTS = 64
STEP = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("siblings", T.ArrayType(T.StringType()))])
PROOF = T.ArrayType(STEP)


def field(c: Column) -> Column:
    """Encoding of one value: `-` for null, else its length in UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `pos` (from 0 within the group) and `size` (rows of the group) without gathering a group.

    Rows are laid out by ranges of (group, order) and numbered inside each range; only counts of (range, group) meet again.
    """
    local = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())])

    def number(batches) -> Iterator[dict]:
        last, n = None, 0
        for c in batches:
            keys = c[group].to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]]))
            start = np.zeros(len(keys), np.int64)
            start[edge] = edge
            start = np.maximum.accumulate(start)
            rank = np.arange(len(keys)) - start
            rank[:edge[0] if len(edge) else len(keys)] += n
            last, n = keys[-1], int(rank[-1]) + 1
            yield c | {"_rank": rank}
    spread = df.repartitionByRange(*[F.col(c) for c in (group, *order)]).withColumn("_part", F.spark_partition_id())
    rows = stash(arrow_map(spread.sortWithinPartitions(group, *order), number, local))
    counts = stash(rows.groupBy("_part", group).agg(F.count("*").alias("_n")))
    # A group has at most as many rows here as there are ranges.
    ranges = Window.partitionBy(group)
    upto = F.sum("_n").over(ranges.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    starts = counts.select("_part", group, (upto - F.col("_n")).alias("_start"), F.sum("_n").over(ranges).alias("size"))
    return rows.join(starts, ["_part", group]).withColumn("pos", F.col("_start") + F.col("_rank")).drop("_part", "_rank", "_start")


class OpenBlock:
    """Runs of siblings of one aligned block: the last run of every level is open and grows as children complete."""

    def __init__(self, fan_out: int, levels: int):
        self.fan_out, self.runs = fan_out, [[[]] for _ in range(levels)]

    def append(self, digest: str, level: int = 0) -> None:
        """A completed node joins its open run and thereby the witness of all leaves below its siblings."""
        if level == len(self.runs):
            self.root = digest
            return
        runs = self.runs[level]
        runs[-1].append(digest)
        if len(runs[-1]) == self.fan_out:
            self._complete(level)

    def _complete(self, level: int) -> None:
        node = hashlib.sha256("".join(self.runs[level][-1]).encode()).hexdigest()
        self.runs[level].append([])
        self.append(node, level + 1)

    def seal(self) -> str:
        """Ends the input: open runs become nodes although they are short, from the bottom up."""
        for level, runs in enumerate(self.runs):
            if runs[-1]:
                self._complete(level)
        return self.root

    def witnesses(self) -> pa.Array:
        """For each leaf, level by level, its place in its run and the run's other members."""
        leaves = sum(len(r) for r in self.runs[0])
        offsets, at, steps = [0], np.arange(leaves), []
        flat, starts, base = [], [], 0
        for runs in self.runs:
            nodes = [d for r in runs for d in r]
            starts.append((base, len(nodes)))
            flat += nodes
            base += len(nodes)
        levels, place = len(self.runs), []
        for base, count in starts:
            first = at // self.fan_out * self.fan_out
            width = np.minimum(first + self.fan_out, count) - first
            place.append(at - first)
            steps.append((base + first, width))
            at = at // self.fan_out
        # leaf-major order of (leaf, level)
        places = np.stack(place, 1).ravel()
        begin = np.stack([s for s, _ in steps], 1).ravel()
        width = np.stack([w for _, w in steps], 1).ravel() - 1
        edge = np.concatenate([[0], np.cumsum(width)])
        inner = np.arange(edge[-1]) - np.repeat(edge[:-1], width)
        pick = np.repeat(begin, width) + inner + (inner >= np.repeat(places, width))
        siblings = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat, pa.string()).take(pa.array(pick)))
        step = pa.StructArray.from_arrays([pa.array(places, pa.int32()), siblings], ["place", "siblings"])
        return pa.ListArray.from_arrays(pa.array(np.arange(leaves + 1) * levels, pa.int32()), step)


def depth(size: int, fan_out: int) -> int:
    """Levels of hashing until one node of `size` remains."""
    n = 0
    while size > 1:
        size, n = -(-size // fan_out), n + 1
    return n


def blocks(df: DataFrame, group: str, digest: str, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """Streams every block of rows (group, pos, size, digest); adds `proof` within the block, `block` and `block_root`.

    A task holds one block: at most fan_out ** levels rows.
    """
    width = fan_out ** levels
    rows = df.withColumn("block", F.floor(F.col("pos") / width))
    target = T.StructType([*rows.schema, T.StructField("proof", PROOF), T.StructField("block_root", T.StringType())])

    def close(parts: list[pa.RecordBatch]) -> dict:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        c = dict(zip(whole.schema.names, whole.columns))
        tree = OpenBlock(fan_out, min(levels, depth(c["size"][0].as_py(), fan_out)))
        if tree.runs:
            for d in c[digest].to_pylist():
                tree.append(d)
            root = tree.seal()
            return c | {"proof": tree.witnesses(), "block_root": [root] * whole.num_rows}
        return c | {"proof": pa.array([[]], pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))),
                    "block_root": c[digest]}

    def run(batches) -> Iterator[dict]:
        open_rows: list[pa.RecordBatch] = []
        key = None
        for c in batches:
            b = pa.RecordBatch.from_arrays(list(c.values()), names=list(c))
            groups, numbers = c[group].to_numpy(zero_copy_only=False), c["block"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((groups[1:] != groups[:-1]) | (numbers[1:] != numbers[:-1])) + 1).tolist(), len(groups)]
            for a, z in zip(edges, edges[1:]):
                if (now := (groups[a], numbers[a])) != key and open_rows:
                    yield close(open_rows)
                    open_rows = []
                key = now
                open_rows.append(b.slice(a, z - a))
        if open_rows:
            yield close(open_rows)
    return arrow_map(rows.repartition(group, "block").sortWithinPartitions(group, "block", "pos"), run, target)


def tree(df: DataFrame, group: str, digest: str, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """Rows (group, pos, size, digest and others) with their full `proof` up to the root of their group, and that `root`."""
    width = fan_out ** levels
    rounds = [stash(blocks(df, group, digest, fan_out, levels))]
    most = df.agg(F.max("size")).first()[0] or 0
    while most > width:
        most = -(-most // width)
        below = rounds[-1].where(F.col("pos") % width == 0)
        nodes = below.select(group, F.col("block").alias("pos"), F.ceil(F.col("size") / width).alias("size"), F.col("block_root").alias("_node"))
        rounds.append(stash(blocks(nodes, group, "_node", fan_out, levels)))
    top = rounds.pop()
    done = top.select("*", F.col("block_root").alias("root"))
    for below in reversed(rounds):
        above = done.select(group, F.col("pos").alias("block"), F.col("proof").alias("_above"), F.col("root"))
        done = below.join(above, [group, "block"]).withColumn("proof", F.concat("proof", "_above")).drop("_above")
    return done.drop("block", "block_root")


def fold(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(
        F.array_join(F.slice(step["siblings"], F.lit(1), step["place"]), ""), node,
        F.array_join(F.slice(step["siblings"], step["place"] + 1, F.size(step["siblings"])), "")), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda step: step["siblings"])), ""), 256)


def merkle_manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", digest: str = "leaf",
                    fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """Every leaf with `subroot` (root of its group), `root` (of all groups) and `proof` from the leaf to `root`.

    Leaves of a group ascend by `order`, nulls first; rows of equal order by digest, so equal rows have any order among
    themselves and the same result. Groups ascend bytewise, null first. A group of one leaf has that leaf as its subroot, one
    group's subroot is the root. An empty table gives no rows. Other columns are carried; columns named subroot, root or
    proof are replaced. A group may hold any share of the rows: ranges, blocks and counts bound what meets in a task.
    """
    # Column names of the input stay out of the way: the tree works on one struct and four names of its own.
    rest = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    named = lambda c: F.col(f"`{c.replace('`', '``')}`")                            # noqa: E731
    g = named(group).cast("string")
    own = stash(leaves.select(F.struct(*map(named, rest)).alias("_row"), F.when(g.isNull(), "").otherwise(F.concat(F.lit("="), g)).alias("_g"),
                        named(order).alias("_o"), named(digest).alias("_leaf")))
    rows = tree(ranked(own, "_g", ["_o", "_leaf"]), "_g", "_leaf", fan_out, levels)
    subroots = rows.where("pos = 0").select(F.lit("").alias("_all"), F.col("_g"), F.col("root").alias("_subroot"))
    tops = tree(ranked(subroots, "_all", ["_g"]), "_all", "_subroot", fan_out, levels)
    tops = tops.select("_g", F.col("_subroot").alias("subroot"), F.col("proof").alias("_top"), F.col("root").alias("_root"))
    # The hot group meets its one row here; rows of a group differ in nothing that could spread them, so they are salted.
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    joined = rows.withColumn("_salt", F.pmod(F.floor(F.col("pos") / 64), F.lit(SALTS))).join(
        tops.withColumn("_salt", F.explode(salts)), ["_g", "_salt"])
    return joined.select("_row.*", "subroot", F.col("_root").alias("root"), F.concat("proof", "_top").alias("proof"))


def merkle_sql(table: str, group: str, order: str, columns: list[str], text: str) -> str:
    """SQL of the manifest of `table` and of proofs against rows whose `text` was lowered where 5 divides crc32(order)."""
    def leaf(changed: str | None = None) -> str:
        names = [(f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == changed else f"CAST({c} AS VARCHAR)")
                 for c in columns]
        return "sha256(" + " || ".join(f"COALESCE(strlen({n}) || ':' || {n}, '-')" for n in names) + ")"
    eight = ", ".join(["-1"] * 8)
    crc = f"""xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({order} AS VARCHAR), ''),
        lambda x: [ascii(x), {eight}]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
        ELSE c >> 1 END))"""

    def rise(name: str, start: str, key: str) -> str:
        return f"""{name}(level, {key}, pos, h, n) AS ({start} UNION ALL SELECT level + 1, {key}, pos // {FAN_OUT},
            sha256(string_agg(h, '' ORDER BY pos)), (n + {FAN_OUT - 1}) // {FAN_OUT} FROM {name} WHERE n > 1 GROUP BY level, {key}, pos // {FAN_OUT}, n)"""

    def climb(name: str, nodes: str, start: str, key: str, kept: str) -> str:
        # one row for each leaf and level: the node so far, true and tampered, and the siblings met on the way
        return f"""{name}_runs AS (SELECT level, {key}, pos // {FAN_OUT} AS run, list(h ORDER BY pos) AS hs FROM {nodes} WHERE n > 1 GROUP BY ALL),
            {name} AS ({start} UNION ALL SELECT {kept}, {key}, level + 1, pos // {FAN_OUT},
                sha256(array_to_string(list_concat(hs[:pos % {FAN_OUT}], list_concat([folded], hs[pos % {FAN_OUT} + 2:])), '')),
                sib || array_to_string(list_concat(hs[:pos % {FAN_OUT}], hs[pos % {FAN_OUT} + 2:]), '')
                FROM {name} JOIN {name}_runs USING (level, {key}) WHERE run = pos // {FAN_OUT})"""
    return f"""WITH RECURSIVE l AS (SELECT {order} AS id, COALESCE('=' || {group}, '') AS g, {leaf()} AS leaf,
            CASE WHEN {crc} % 5 = 0 THEN {leaf(text)} ELSE {leaf()} END AS tampered FROM {table}),
        o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
        {rise("t", "SELECT 0, g, pos, leaf, n FROM o", "g")},
        s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
        {rise("u", "SELECT 0, 0, pos, h, n FROM s", "k")},
        {climb("c", "t", "SELECT id, leaf, g, 0 AS level, pos, tampered AS folded, '' AS sib FROM o", "g", "id, leaf")},
        top AS (SELECT c.* FROM c JOIN (SELECT g, max(level) AS level FROM t GROUP BY 1) USING (g, level)),
        d0 AS (SELECT id, leaf, s.h AS subroot, s.pos, folded, sib FROM top JOIN s USING (g)),
        {climb("d", "u", "SELECT id, leaf, subroot, 0 AS k, 0 AS level, pos, folded, sib FROM d0", "k", "id, leaf, subroot")}
        SELECT id AS {order}, leaf, subroot, r.h AS root, sha256(sib) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
        FROM d JOIN (SELECT level, h FROM u WHERE n = 1) r USING (level)"""
