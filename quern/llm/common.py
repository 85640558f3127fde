"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which driver and executors share (see ``quern.storage``),
and are deleted once their successor stands.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_path, shared_root, stored

__all__ = ["connected_components", "discard", "documents", "map_batches", "released", "shared_path", "shared_root", "stored", "worker_memo"]


def released(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more.  It does so when the driver
    collects its garbage, which may be hours after a large shuffle has served its purpose.  Twice:
    the first round frees what Python held, the second what that held in turn."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies fn to each Arrow batch; a batch for which it returns None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def worker_memo(key: str, make: Callable[[], object]) -> object:
    """One object per Python worker process; workers are reused between tasks."""
    memo = _MEMO.get(key)
    if memo is None:
        _MEMO.clear()
        memo = _MEMO[key] = make()
    return memo


_MEMO: dict[str, object] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``edges(a, b)``.

    Alternating large-star and small-star steps [Kiveris et al., 2014].  Each step
    is a minimum per node (combined before the shuffle) and an equi-join that
    adaptive execution can split, so no neighbourhood is gathered in a task; the
    edges between steps are tables in the shared folder.  It takes a number of
    rounds logarithmic in the length of paths.  Null ends are ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges = stored(edges, "edges")
    for _ in range(max_rounds):
        # done when every node has one link at most and leads to one that has none
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e")).select("e.*")
        if not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or out = 1 and `in` = 1").limit(1).count():
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, old = stored(large, "edges"), edges
        discard(old)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = stored(edges, "edges")
        discard(large)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
