"""Shared pieces: durable intermediate tables, whole-row Arrow maps, connected components."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earlog.session import ensure_checkpoint_dir

#: Rows per Arrow batch: texts of a few kB make batches of a few MB.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that bound the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it no column of the input, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def stash(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: the lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """mapInArrow where fn gets and gives dictionaries of columns (Arrow arrays in, lists or arrays out).

    Columns go to Python by position, so any name will do.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    names = df.columns
    target = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches):
        def columns():
            for b in batches:
                if b.num_rows:
                    yield dict(zip(names, b.columns))
        for out in fn(columns()):
            yield pa.RecordBatch.from_arrays(
                [v.cast(f.type) if isinstance(v := out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(v, f.type) for f in target],
                schema=target)
    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): (node, component), the smallest node reachable.

    Minimum labels are hooked to neighbours and to their roots, then labels jump to the label of their label; rounds grow
    with the logarithm of the longest path. Every round reads written tables and joins them on plain keys, so adaptive
    joins can split a node with very many links. Nothing but one checksum per round comes to the driver.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("label")))
    before = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(20,0)")), F.count("*")).first()
        if now[1] == 0 or now == before:
            return labels.select("node", F.col("label").alias("component"))
        before = now
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        own = stash(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("near")))
        hooked = stash(own.select("node", F.col("near").alias("label"))
                       .union(own.select(F.col("label").alias("node"), F.col("near").alias("label")))
                       .groupBy("node").agg(F.min("label").alias("label")))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = stash(hooked.join(up, "label").select("node", F.col("above").alias("label")))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
