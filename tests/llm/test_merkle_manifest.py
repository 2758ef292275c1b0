import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from earlog.llm import merkle_manifest as mm
from earlog.llm.queries import LEAF, op12_merkle, registered


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encode(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes, fan):
    """Root and, for every node, its proof steps (place, siblings)."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[k:k + fan] for k in range(0, len(level), fan)]
        for i, p in enumerate(proofs):
            run = runs[at[i] // fan]
            p.append((at[i] % fan, run[:at[i] % fan] + run[at[i] % fan + 1:]))
            at[i] //= fan
        level = [H(*r) for r in runs]
    return level[0], proofs


def brute(rows, fan):
    """rows: (group, order, leaf) -> {(group, order, leaf): [(subroot, root, proof), ...]}."""
    groups = defaultdict(list)
    for g, o, leaf in rows:
        groups[g].append((o is not None, o or 0, leaf, o))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: r[:3])
    local = {g: climb([r[2] for r in groups[g]], fan) for g in names}
    root, tops = climb([local[g][0] for g in names], fan)
    out = defaultdict(list)
    for g, top in zip(names, tops):
        for r, p in zip(groups[g], local[g][1]):
            out[g, r[3], r[2]].append((local[g][0], root, p + top))
    return {k: sorted(v) for k, v in out.items()}


def got(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["source"], r["doc_id"], r["leaf"]].append((r["subroot"], r["root"], [(s["place"], list(s["siblings"])) for s in r["proof"]]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("fan,levels", [(2, 1), (2, 3), (3, 2), (16, 1)])
def test_many_rounds(spark, fan, levels):
    """Hot group, lone leaves, equal ids, equal rows, null ids, null and odd group names; blocks far smaller than groups."""
    rng = random.Random(fan * 10 + levels)
    names = [None, "", "=", "é", "z", "a b", "\U0001f600", "Z"] + [f"g{i}" for i in range(21)]
    rows = [("hot", i % 150, H(str(i))) for i in range(201)] + [(rng.choice(names), rng.choice([None, 3, rng.randrange(50)]), H(str(i % 60))) for i in range(120)]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string").repartition(7)
    assert got(mm.merkle_manifest(df, fan_out=fan, levels=levels)) == brute(rows, fan)


def test_query_against_brute_force(spark, sf, docs):
    rows = docs.select(*LEAF).collect()
    leaves = [(r["source"], r["doc_id"], H(encode(r))) for r in rows]
    want = brute(leaves, 16)
    lower = {r["doc_id"]: H(encode(list(r)[:-1] + [r["text"].encode().lower().decode()])) if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
             else H(encode(r)) for r in rows}
    res = {r["doc_id"]: r for r in op12_merkle(spark, sf).collect()}
    assert len(res) == len(rows)
    for g, d, leaf in leaves:
        [(subroot, root, proof)] = want[g, d, leaf]
        node = lower[d]
        for k, sib in proof:
            node = H(*sib[:k], node, *sib[k:])
        assert tuple(res[d]) == (d, leaf, subroot, root, H(*(s for _, sib in proof for s in sib)), node, node == root)
    assert any(r["verified"] for r in res.values()) and not all(r["verified"] for r in res.values())


def test_sql(spark, sf):
    fn, sql = registered()["op12_merkle"]
    assert compare(fn(spark, sf), sql, connect(sf)) == ""


def test_open_block_is_incremental():
    block = mm.OpenBlock(4, 2)
    for i in range(6):
        block.append(str(i))
    assert block.runs[0] == [["0", "1", "2", "3"], ["4", "5"]] and block.runs[1] == [[H("0", "1", "2", "3")]]   # 4 and 5 wait for siblings
    block.append("6")
    assert block.runs[0][1] == ["4", "5", "6"]                                                                   # and see 6 join
    assert block.seal() == H(H("0", "1", "2", "3"), H("4", "5", "6"))
    assert block.witnesses().to_pylist()[5] == [{"place": 1, "siblings": ["4", "6"]}, {"place": 1, "siblings": [H("0", "1", "2", "3")]}]


def test_proofs_catch_any_change(spark):
    rows = [(f"s{i % 3}", i, H(str(i))) for i in range(40)]
    out = mm.merkle_manifest(spark.createDataFrame(rows, "source string, doc_id long, leaf string"), fan_out=3, levels=2)
    own, other = mm.fold(F.col("leaf"), F.col("proof")), mm.fold(F.sha2("leaf", 256), F.col("proof"))
    assert {tuple(r) for r in out.select(own == F.col("root"), other == F.col("root")).collect()} == {(True, False)}
    moved = mm.fold(F.col("leaf"), F.transform("proof", lambda s: F.struct(F.lit(0).alias("place"), s["siblings"].alias("siblings"))))
    assert out.where(moved == F.col("root")).count() < 40


def test_one_and_none(spark):
    one = spark.createDataFrame([(None, None, "ab")], "source string, doc_id long, leaf string")
    r = mm.merkle_manifest(one).select("*", mm.proof_digest(F.col("proof")).alias("digest")).first()
    assert r["subroot"] == r["root"] == "ab" and r["proof"] == [] and r["digest"] == H()
    assert mm.merkle_manifest(one.limit(0)).count() == 0


def test_odd(spark, odd_docs):
    leaves = odd_docs.select("*", mm.leaf_hash(*[F.col(c) for c in LEAF]).alias("leaf"), F.lit(1).alias("root"), F.lit(2).alias("_g"), F.lit(3).alias("pos"),
                             F.lit(4).alias("a`b"))
    want = {(r["doc_id"], H(encode([r[c] for c in LEAF]))) for r in odd_docs.collect()}
    out = mm.merkle_manifest(leaves, levels=1)
    rows = out.collect()
    assert {(r["doc_id"], r["leaf"]) for r in rows} == want and len(rows) == odd_docs.count()
    assert len({r["root"] for r in rows}) == 1 and set(out.columns) == set(leaves.columns) | {"proof", "subroot"}
    assert out.where(mm.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert mm.merkle_manifest(leaves).count() == odd_docs.count()
