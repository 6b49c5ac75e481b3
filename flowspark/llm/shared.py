"""What several operators of this subpackage need: the shared folder, tables written
there to cut lineage, and connected components.

The folder is the one that the cluster names in spark.checkpoint.dir. Only where that
setting is absent and Spark runs on one machine, a temporary folder is used; elsewhere its
absence is an error. Tables are written
with Spark's own writer, so a lost executor costs a recomputation of its tasks only.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mix


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, Python tasks get batches of so many rows: texts can be long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back."""
    path = table_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of their u. The edges of a hub are dealt to SALTS tasks, each with its own copy of m."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return dealt.join(copies.hint("shuffle_hash"), ["u", "salt"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component of every node with an edge.

    edges: columns a and b. Large-star and small-star steps in turn (Kiveris and others,
    2014): each is one grouping by node, the number of rounds is logarithmic, and a hub is
    never gathered into one task (its minimum is an aggregate, its neighbours stay rows).
    Loops and repeated edges are harmless. No edges: no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large star: neighbours above u are linked to the least of u and its neighbours
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u, are linked to the least of them
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        now = written(
            _with_least(now, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "edges",
        )
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


SIEVE_BITS = 1 << 25


def _slot(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(SIEVE_BITS)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = np.unique(_slot(batch.column(0).to_numpy(zero_copy_only=False)))
        yield pa.record_batch([pa.array((s >> np.uint64(3)).astype(np.int32)), pa.array((1 << (s & np.uint64(7)).astype(np.int32)).astype(np.int32))], ["byte", "bits"])


class Sieve:
    """One bit for each slot that an id falls into: SIEVE_BITS / 8 bytes, whatever the input.

    Ids of the set always pass; others pass as often as the set fills the slots.
    """

    def __init__(self, ids: DataFrame) -> None:
        """ids: one column of longs, no nulls."""
        got = ids.mapInArrow(_slots, "byte int, bits int").groupBy("byte").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
        self.bits = np.zeros(SIEVE_BITS // 8, np.uint8)
        self.bits[got["byte"].to_numpy()] = got["bits"].to_numpy().astype(np.uint8)

    def passes(self, ids: np.ndarray) -> np.ndarray:
        h = _slot(ids)
        return (self.bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
