"""Centroid clustering by Lloyd's rounds on column blocks.

Vectors become integers and are cut into blocks of columns. A chunk of vectors is one record per block, and blocks are written apart, so a
task works on one block with that block's slice of the centroids. A round: every block task computes the exact partial squared distances
of its chunks to the centroid slices; partial distances are reduced by chunk, which adds the blocks and takes the nearest centroid; the
chosen numbers meet the blocks again, and each block sums its own columns per cluster and updates its own slice. No task that computes holds
more than a slice, k x width numbers, which is the one thing broadcast. A round moves distances and, narrower, numbers and blocks.

All arithmetic is in integers, so results do not depend on partitions. Records use the narrowest integers that hold them.

Defined results: a vector with another number of components, or with a null or non-finite one, is left out, as is one with a component of 2^21
or more in magnitude, whose distances would not fit 64 bits; equal distances go to the smaller centroid; an empty centroid stays; fewer kept
vectors than ``k`` give as many centroids; null or repeated ids keep their rows (null ids are first centroids last, equal ids by their
components); a table without kept vectors gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import saved, shared_path

CHUNK = 2048  # vectors of a record
WIDTH = 16  # columns of a block
LIMIT = 1 << 27  # of an integer component: 64 squared differences fit 64 bits
SCALE = 64


def _narrow(values: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them all."""
    top = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    kind = "<i1" if top < 1 << 7 else "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return values.astype(kind).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` integers again."""
    return np.frombuffer(raw, f"<i{len(raw) // n}").astype(np.int64)


def integers(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int = SCALE) -> DataFrame:
    """``id`` and ``x``, the integer components of the vectors that are kept."""
    value = F.col(vector_col).cast("array<double>")
    small = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < LIMIT)
    kept = vectors.select(F.col(id_col).alias("id"), value.alias("x")).where((F.size("x") == dim) & F.forall("x", small))
    return kept.select("id", F.transform("x", lambda x: F.floor(x * scale)).alias("x"))


def first_centroids(kept: DataFrame, k: int) -> list[list[int]]:
    """Components of the ``k`` vectors whose hashed ids come first; nothing else of the table leaves the executors."""
    rank = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    return [r.x for r in kept.select(rank.alias("rank"), "x").orderBy(F.col("rank").asc_nulls_last(), "x").limit(k).collect()]


def chunks(kept: DataFrame, width: int, chunk: int) -> DataFrame:
    """``chunk`` (a number), ``ids``, ``n`` and ``parts`` (one blob of integers per column block)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                parts = [_narrow(x[:, c:c + width]) for c in range(0, x.shape[1], width)]
                offsets = pa.array([0, part.num_rows], pa.int32())
                ids = pa.ListArray.from_arrays(offsets, part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), ids, pa.array([part.num_rows], pa.int64()), pa.array([parts], pa.list_(pa.binary()))], names=["chunk", "ids", "n", "parts"])
                number += 1

    return kept.mapInArrow(run, f"chunk long, ids array<{kept.schema['id'].dataType.simpleString()}>, n long, parts array<binary>")


def _shards(table: DataFrame, dim: int, width: int) -> DataFrame:
    """``block``, ``chunk``, ``n``, ``wide`` (columns) and ``x``: every block in files of its own."""
    spark, path = table.sparkSession, shared_path(table.sparkSession, "lloyd-shards")
    parts = table.select("chunk", "n", F.posexplode("parts").alias("block", "x"))
    parts.withColumn("wide", F.least(F.lit(width), dim - F.col("block") * width)).write.partitionBy("block").parquet(path)
    return spark.read.schema("chunk long, n long, x binary, wide int, block int").parquet(path)


def _slices(spark, centroids: list[list[int]], width: int) -> DataFrame:
    """``block`` and ``slice``: that block's columns of all centroids, centroid after centroid."""
    dim = len(centroids[0])
    rows = [(b, [v for c in centroids for v in c[at:at + width]]) for b, at in enumerate(range(0, dim, width))]
    return spark.createDataFrame(rows, "block int, slice array<long>")


def partial_distances(shards: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """``chunk``, ``n`` and ``d``: squared distances of a block's columns to its centroid slices, vectors x centroids."""
    rows = shards.join(F.broadcast(slices), "block").select("chunk", "n", "x", "slice")  # one slice per block: k x width numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, raw, own in zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)]):
                centroids = np.array(own, np.int64).reshape(k, -1)
                x = _wide(raw, n * centroids.shape[1]).reshape(n, -1)
                out.append(_narrow(np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["chunk", "n", "d"])

    return rows.mapInArrow(run, "chunk long, n long, d binary")


def nearest(partial: DataFrame, k: int) -> DataFrame:
    """Reduced by chunk: blocks added, then of every vector the nearest centroid (``label``) and its distance (``d``)."""
    def run(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        total = sum(_wide(raw, n * k) for raw in table["d"].to_pylist()).reshape(n, k)
        label = total.argmin(axis=1)  # the first of equal distances
        found = [pa.array([_narrow(x)], pa.binary()) for x in (label, total[np.arange(n), label])]
        return pa.table([table["chunk"].slice(0, 1), *found], names=["chunk", "label", "d"])

    return partial.groupBy("chunk").applyInArrow(run, "chunk long, label binary, d binary")


def updated(shards: DataFrame, labels: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """New slices: every block adds up its own columns per cluster and divides; an empty cluster keeps what it had."""
    rows = shards.join(labels.select("chunk", "label").hint("merge"), "chunk").select("block", "n", "wide", "x", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        sizes: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, wide, raw, marks in zip(*[batch.column(c).to_pylist() for c in range(5)]):
                label, x = _wide(marks, n), _wide(raw, n * wide).reshape(n, wide)
                own = sums.setdefault(block, np.zeros((k, wide), np.int64))
                np.add.at(own, label, x)
                sizes[block] = sizes.get(block, 0) + np.bincount(label, minlength=k)
        for block, own in sums.items():
            at = pa.array(np.arange(own.size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(own.size, block), pa.int32()), at, pa.array(own.ravel()), pa.array(np.repeat(sizes[block], own.shape[1]))], names=["block", "at", "total", "size"])

    cells = rows.mapInArrow(run, "block int, at int, total long, size long").groupBy("block", "at").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))
    mean = F.expr("(total - pmod(total, size)) div size")  # rounded down
    old = slices.select("block", F.posexplode("slice").alias("at", "value"))
    new = old.join(cells.where("size > 0").select("block", "at", mean.alias("mean")), ["block", "at"], "left")
    cell = F.struct("at", F.coalesce("mean", "value").alias("value"))
    return new.groupBy("block").agg(F.sort_array(F.collect_list(cell))["value"].alias("slice"))


def _vectors(labelled: DataFrame) -> DataFrame:
    """``id``, ``cluster``, ``distance`` of every vector of joined chunks."""
    kind = labelled.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids = batch.column(0).slice(at, 1).flatten()
                found = [pa.array(_wide(batch.column(c)[at].as_py(), len(ids))) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([ids, found[0].cast(pa.int32()), found[1]], names=["id", "cluster", "distance"])

    return labelled.select("ids", "label", "d").mapInArrow(run, f"id {kind}, cluster int, distance long")


def digests(slices: DataFrame, k: int) -> DataFrame:
    """``cluster`` and ``centroid_sha256``, of the whole centroid's decimal components joined by commas."""
    cell = slices.select("block", (F.size("slice") / k).cast("int").alias("wide"), F.posexplode("slice").alias("at", "value"))
    cell = cell.select(F.expr("at div wide").cast("int").alias("cluster"), F.struct("block", F.col("at").alias("at"), F.col("value").cast("string").alias("value")).alias("cell"))
    texts = cell.groupBy("cluster").agg(F.concat_ws(",", F.sort_array(F.collect_list("cell"))["value"]).alias("text"))
    return texts.select("cluster", F.sha2("text", 256).alias("centroid_sha256"))


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, width: int = WIDTH, chunk: int = CHUNK,
) -> DataFrame:
    """One row per kept vector: its cluster after ``rounds`` updates, its squared distance, the sums over its cluster and over all, and the
    digest of its centroid."""
    kept = integers(vectors, id_col, vector_col, dim)
    centroids = first_centroids(kept, k)
    spark, k = vectors.sparkSession, len(centroids)
    if not k:
        empty = _vectors(kept.select(F.array("id").alias("ids"), F.lit(b"").alias("label"), F.lit(b"").alias("d")).limit(0))
        sums = [F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")]
        return empty.select(F.col("id").alias(id_col), "cluster", "distance", *sums, F.lit("").alias("centroid_sha256"))
    table = saved(chunks(kept, width, chunk), "lloyd-chunks")
    shards, slices = _shards(table, dim, width), _slices(spark, centroids, width)
    for turn in range(rounds + 1):
        labels = saved(nearest(partial_distances(shards, slices, k), k), "lloyd-labels")
        if turn < rounds:
            slices = saved(updated(shards, labels, slices, k), "lloyd-slices")
    found = saved(_vectors(table.select("chunk", "ids").join(labels.hint("merge"), "chunk")), "lloyd-found")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(digests(slices, k), "cluster")
    total = sum(r.cluster_inertia for r in sums.collect())  # k rows
    return found.join(F.broadcast(sums), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
