"""What several operators share: inputs, folds, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.sources.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows or 16 MB, unless the session has bounds of its own.

    Spark's are 10,000 rows of any size: with long texts each task would hold the same hundreds of MB in the JVM and in Python.
    """
    for name, value in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", "16m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def fold(key: str, parts: int) -> Column:
    """``crc32(key as text) mod parts``: the same split at any size and in any order."""
    return F.crc32(F.col(key).cast("string")) % parts


def key_chunks(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``keys`` into tables of whole keys with at least ``least`` rows each.

    Memory is bounded by ``least`` plus the largest key.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held)
        last = np.zeros(whole.num_rows, dtype=bool)
        for k in keys:
            column = whole[k].to_numpy()
            last |= column != column[-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``size`` nodes reaches over the links ``a - b``."""
    root = np.arange(size)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root = higher
    return root


def drop_staged(spark: SparkSession, frame: DataFrame) -> None:
    """Remove the files of a staged table that nobody will read again."""
    for name in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id of an undirected edge list; the component is its smallest id.

    Alternates two steps until nothing changes: every neighbour above a node is tied to the smallest
    neighbour, then every neighbour below it. Each round is written to the shared folder. A node
    with very many neighbours is a partial minimum and a join that adaptive execution may split;
    its neighbours are never gathered. Empty edge lists give an empty result.
    """
    spark = edges.sparkSession
    now = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"),
        ).select("e.*").filter("u <> v").distinct()
        following = stage(small, "edges")
        drop_staged(spark, now)
        now = following
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.unionAll(roots)
