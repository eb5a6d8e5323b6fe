"""Operator 8: near-duplicate embeddings by Euclidean p-stable hashing.

Unit vectors get, for each of ``TABLES`` tables, a bucket: ``PROJECTIONS`` random
projections, shifted and cut into cells of ``WIDTH``.  At cosine 0.95 (distance
0.316) one projection agrees with probability 0.87 and a table with 0.15, so 20 tables
find 96 % of the pairs at the threshold and more of those above it.  Vectors that share a
bucket are compared exactly, in double precision; a pair counts in the first table in which it meets, so nothing
is counted twice and no pair is ever written out: a bucket returns, per vector, how
many others it links with and one node of its local component.  Large buckets are
dealt out as pairs of blocks.  Equal vectors are one class with a weight.

Defined results: NULL vectors, zero vectors and vectors with NULL, NaN or infinite components: no links, their
own component.  Vectors of different lengths never link.  Repeated ``vec_id``: every row counts as a vector.
NULL ``vec_id``: not linked, component NULL, not kept.  Labels and other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import partitions_for, stored
from tidepanel.llm.components import connected

THRESHOLD = 0.95
TABLES, PROJECTIONS, WIDTH, SEED = 20, 14, 2.0, 11
BLOCK = 1024


def projections(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    n = TABLES * PROJECTIONS
    return rng.normal(size=(dim, n)), rng.uniform(0, WIDTH, n), rng.integers(1, 1 << 62, n, dtype=np.int64) | 1


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    largest = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / largest  # squares of very small or large components stay finite
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def buckets(rows: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name per vector and table."""
    matrix, shift, odd = projections(rows.shape[1])
    cells = np.floor((rows @ matrix + shift) / WIDTH).astype(np.int64)
    with np.errstate(over="ignore"):
        mixed = (cells * odd).reshape(len(rows), TABLES, PROJECTIONS).sum(axis=2)
        return mixed ^ (mixed >> 29)


def _bucket_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            lists = part.column(2)
            lengths = np.array(pc.list_value_length(lists))
            for dim in np.unique(lengths).tolist():
                pick = np.flatnonzero(lengths == dim)
                rows = np.array(lists.take(pa.array(pick)).flatten(), np.float64).reshape(-1, dim)
                names = buckets(unit(rows))
                n = len(pick)
                vectors = [r.tobytes() for r in rows.astype(np.float32)]
                before = [r.astype("<i8").tobytes() for r in names]
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * n, pa.int32()), pa.array(names[:, t]), part.column(0).take(pa.array(pick)), part.column(1).take(pa.array(pick)),
                         pa.array([b[: 8 * t] for b in before], pa.binary()), pa.array(vectors, pa.binary())],
                        names=["tab", "bucket", "rep", "weight", "before", "vector"],
                    )


def _links_in(tab: int, rows: list[tuple], bi: int, bj: int) -> Iterator[tuple[int, int, int]]:
    """(rep, number of linked vectors, a node of the same component) for the pairs of two blocks of one bucket."""
    by_dim: dict[int, list[tuple]] = {}
    for r in rows:
        by_dim.setdefault(len(r[4]), []).append(r)
    for same in by_dim.values():
        if len(same) < 2:
            continue
        rep, weight, block = (np.array([r[k] for r in same], np.int64) for k in (0, 1, 2))
        before = np.frombuffer(b"".join(r[3] for r in same), "<i8").reshape(len(same), tab)
        vectors = unit(np.frombuffer(b"".join(r[4] for r in same), np.float32).reshape(len(same), -1))
        near = vectors @ vectors.T >= THRESHOLD
        np.fill_diagonal(near, False)
        if bi != bj:
            near &= block[:, None] != block[None, :]
        for s in range(tab):
            near &= before[:, s][:, None] != before[:, s][None, :]
        links = near @ weight
        label = np.arange(len(same))
        while True:  # smallest place reachable, inside the block pair
            least = np.minimum(label, np.where(near, label[None, :], len(same)).min(axis=1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        for i in np.flatnonzero(links).tolist():
            yield int(rep[i]), int(links[i]), int(rep[label[i]])


def _link_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, rows = None, []

    def batch_of():
        found = list(_links_in(key[0], rows, key[2], key[3])) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["rep", "links", "head"]) if found else None

    for batch in source:
        for tab, bucket, bi, bj, *row in zip(*(batch.column(k).to_pylist() for k in range(9))):
            if (tab, bucket, bi, bj) != key:
                if found := key and batch_of():
                    yield found
                key, rows = (tab, bucket, bi, bj), []
            rows.append(row)
    if found := key and batch_of():
        yield found


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    valid = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid).withColumn("key", F.xxhash64("embedding"))
    classes = rows.where("valid").groupBy("key", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = stored(classes, "vector-classes")
    hashed = classes.select("rep", "weight", "embedding").mapInArrow(
        _bucket_batches, "tab int, bucket bigint, rep bigint, weight bigint, before binary, vector binary"
    )
    # Bucket sizes need the names alone; buckets of one vector are dropped before any vector moves.
    hashed = stored(hashed, "vector-buckets")
    sizes = hashed.groupBy("tab", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    seated = hashed.join(sizes, ["tab", "bucket"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    seated = seated.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meets = F.expr("explode(transform(sequence(0, blocks - 1), j -> struct(least(block, j) as bi, greatest(block, j) as bj)))")
    keys = ["tab", "bucket", "bi", "bj"]
    tiles = seated.withColumn("at", meets).select("tab", "bucket", "at.bi", "at.bj", "rep", "weight", "block", "before", "vector")
    tiles = tiles.repartition(partitions_for(vectors.sparkSession), *keys).sortWithinPartitions(*keys)
    found = stored(tiles.mapInArrow(_link_batches, "rep bigint, links bigint, head bigint"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected(found.select(F.col("rep").alias("a"), F.col("head").alias("b")))
    named = classes.join(counts, "rep", "left").join(labels, classes["rep"] == labels["node"], "left")
    named = named.select(
        "key", F.col("embedding").alias("same"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    joined = rows.join(named, F.col("valid") & (rows["key"] == named["key"]) & (F.col("embedding") == F.col("same")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op8_near_vectors(spark: SparkSession, root: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{root}/embeddings.parquet").select("vec_id", "embedding"))
