"""SimHash near-duplicates: segment-popcount embedding, grid range join under the Manhattan distance, exact verification.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the vector of their bit counts. Flipping one bit moves
one coordinate by one, so the Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints: pairs
within ``bits`` are within ``bits`` in the embedding. The vector is kept in unary (0: 00, 1: 01, 2: 11), where the Manhattan
distance is a bit count of an exclusive or.

Grid: the coordinates form ``bits + 3`` blocks; vectors within ``bits`` agree in at least three whole blocks. For each choice of
three blocks the space projected on them is a grid whose cells are single vectors, and a range join only has to look inside a
cell. Cells are filled evenly by unlike texts. A cell that near copies fill beyond ``cell_rows`` is cut by a second grid on the
blocks that are left, and what is still larger is compared chunk against chunk, each pair of chunks a task group of bounded size
that returns a spanning forest, not its pairs. No candidate is capped.

Groups are connected components, found by contracting edges: every vertex joins the neighbour of the highest random priority,
which at least halves long chains, and edges are rewritten between the joined vertices until no more than ``LAST`` are left, a bound whatever
the graph; these are joined at once, as every further turn would be as many tasks for a few rows.

Defined results: null text counts as empty; texts without a word have fingerprint zero, linked like any other; null or repeated
ids keep their rows, and the component is the smallest non-null id of the group (null if there is none); an empty table
gives an empty result; other columns are not read; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import saved

SEED = 42
LOW_BITS = 0x5555555555555555
CELL_ROWS = 64
CHUNK = 2048
HASHES = 1 << 16  # hashes turned into bits at a time
LAST = 4096  # edges; what contraction leaves of a graph of any size is joined at once when it has no more


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, unsigned."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[k:k + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the ASCII-lower-cased words, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*[words[k:] for k in range(shingle)])), len(words) - shingle + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the 64 bits as a long) of every row."""
    rows = docs.select(*[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"k{k} {rows.schema[f'k{k}'].dataType.simpleString()}" for k in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(len(keep))), np.uint64, batch.num_rows)
            names = [f"k{k}" for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*names, "fp"])

    return rows.mapInArrow(run, f"{kinds}, fp long").toDF(*keep, "fp")


# --- embedding and grid ---------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(of: int, blocks: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` out of ``blocks`` runs of the two-bit segments that ``of`` covers."""
    segments = [s for s in range(32) if of >> (2 * s) & 3]
    cuts = [round(len(segments) * k / blocks) for k in range(blocks + 1)]
    runs = [sum(3 << (2 * s) for s in segments[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(runs, agree)]


def _longs(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary."""
    high = F.shiftrightunsigned(fp, 1)
    low_bits = F.lit(LOW_BITS)
    either, both = fp.bitwiseOR(high).bitwiseAND(low_bits), fp.bitwiseAND(high).bitwiseAND(low_bits)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _cells(masks: Column, point: Column, *more: Column) -> Column:
    """One grid cell per mask, as a hash; a collision only adds candidates."""
    return F.transform(masks, lambda mask, k: F.xxhash64(k, *more, point.bitwiseAND(mask)))


def _with_size(cells: DataFrame, name: str) -> DataFrame:
    """Rows of cells with two members or more, and the cell's size. Both sides are exchanged plainly, so a hot cell is split."""
    sizes = saved(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name)
    return cells.join(sizes, "cell")


def _forest(bits: int):
    """Links within a task group of at most two chunks, thinned to a spanning forest."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(group["fp"].to_numpy().view(np.uint64))
        parent = np.arange(len(fps))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for a in range(len(fps) - 1):
            for b in a + 1 + np.flatnonzero(np.bitwise_count(fps[a + 1:] ^ fps[a]) <= bits):
                if (ra := root(a)) != (rb := root(b)):
                    parent[max(ra, rb)] = min(ra, rb)
                    links.append((a, b))
        a, b = (np.array(x, np.int64) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"src": fps[a].view(np.int64), "dst": fps[b].view(np.int64)})

    return run


def links(distinct: DataFrame, bits: int = 3, cell_rows: int = CELL_ROWS, chunk: int = CHUNK) -> DataFrame:
    """Links (``src``, ``dst``) between different fingerprints that join all pairs within ``bits``: every pair of a small cell,
    a spanning forest of each part of a large one."""
    every = (1 << 64) - 1
    masks = _masks(every, bits + 3, 3)
    point = embedding(F.col("fp"))
    first = distinct.select("fp", F.posexplode(_cells(_longs(masks), point)).alias("grid", "cell"))
    first = saved(_with_size(first, "simhash-cells"), "simhash-members")
    # members of a hot cell agree in three blocks; a second grid cuts it along the others, each halved
    fine = F.array(*[_longs([m | mask for m in _masks(every & ~mask, 2 * bits, bits)]) for mask in masks])
    hot = first.where(F.col("n") > chunk).select("fp", F.explode(_cells(F.get(fine, F.col("grid")), point, F.col("cell"))).alias("cell"))
    second = _with_size(hot, "simhash-fine")
    small = first.where(F.col("n") <= cell_rows).select("cell", "fp")
    medium = first.where((F.col("n") > cell_rows) & (F.col("n") <= chunk)).select("cell", "fp", "n")
    point_a, point_b = embedding(F.col("a.fp")), embedding(F.col("b.fp"))
    pairs = small.alias("a").join(
        small.alias("b"),
        (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
        & (_distance(point_a, point_b) <= bits) & (_distance(F.col("a.fp"), F.col("b.fp")) <= bits),
    ).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    parts = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = medium.unionByName(second.select("cell", "fp", "n")).select("cell", "fp", parts.alias("parts"), mine.alias("mine"))
    dealt = dealt.select("cell", "fp", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least(F.col("mine"), other).alias("i"), F.greatest(F.col("mine"), other).alias("j")))).alias("ij"))
    forests = dealt.select("cell", "ij.i", "ij.j", "fp").groupBy("cell", "i", "j").applyInPandas(_forest(bits), "src long, dst long")
    return pairs.unionByName(forests).distinct()


# --- components -----------------------------------------------------------------


def _roots(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Every vertex of a few edges, with one of its component."""
    head: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := head.setdefault(x, x)) != x:
            head[x] = x = head[up]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        head[max(ra, rb)] = min(ra, rb)
    return [(x, root(x)) for x in head]


def components(edges: DataFrame, name: str = "components", last: int = LAST) -> DataFrame:
    """``node`` and ``rep`` (any one vertex of its component) of every vertex of ``edges`` (``src``, ``dst``)."""
    edges = saved(edges.where("src <> dst"), f"{name}-edges")
    labels = saved(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", F.col("node").alias("rep")), f"{name}-labels")
    turn = 0
    while len(rest := edges.take(last + 1)) > last:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("priority"), F.col(c).alias("id"))  # noqa: B023, E731
        best = both.groupBy("src").agg(F.min(rank("dst")).alias("best"))
        joins = saved(best.select(F.col("src").alias("v"), F.least(F.col("best"), rank("src"))["id"].alias("to")), f"{name}-joins")
        at = lambda k: joins.select(F.col("v").alias(f"v{k}"), F.col("to").alias(f"to{k}"))  # noqa: B023, E731
        labels = saved(labels.join(at(0), F.col("rep") == F.col("v0"), "left").select("node", F.coalesce("to0", "rep").alias("rep")), f"{name}-labels")
        moved = edges.join(at(1), F.col("src") == F.col("v1")).select(F.col("to1").alias("src"), "dst") \
            .join(at(2), F.col("dst") == F.col("v2")).select("src", F.col("to2").alias("dst")).where("src <> dst")
        edges = saved(moved.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), f"{name}-edges")
        turn += 1
    if not rest:
        return labels
    roots = edges.sparkSession.createDataFrame(_roots([(e["src"], e["dst"]) for e in rest]), labels.schema).toDF("v", "to")
    return saved(labels.join(F.broadcast(roots), F.col("rep") == F.col("v"), "left").select("node", F.coalesce("to", "rep").alias("rep")), f"{name}-labels")


def _heads(prints: DataFrame, first: Column, bits: int) -> DataFrame:
    """``fp`` and ``head``: the smallest ``first`` among the rows of all fingerprints that links reach."""
    classes = saved(prints.groupBy("fp").agg(F.min(first).alias("first")), "simhash-classes")
    labels = components(links(classes.select("fp"), bits), "simhash").withColumnRenamed("node", "fp")
    linked = saved(classes.join(labels, "fp", "left").select("fp", "first", F.coalesce("rep", "fp").alias("rep")), "simhash-linked")
    heads = saved(linked.groupBy("rep").agg(F.min("first").alias("head")), "simhash-heads")
    return saved(linked.join(heads, "rep").select("fp", "head"), "simhash-found")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` (long) and ``component_id``, the smallest id reachable over links."""
    prints = saved(fingerprints(docs, [id_col], text_col, shingle), "simhash-prints")
    found = _heads(prints, F.col(id_col), bits)
    return prints.join(found, "fp").select(id_col, "fp", F.col("head").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """The documents with one of each group left, that of the smallest id (nulls last; of equal ids any one); all columns."""
    rows = saved(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("no")), "simhash-rows")
    flat = rows.select("no", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    prints = saved(fingerprints(flat, ["no", "id"], "text", shingle), "simhash-prints")
    found = _heads(prints, F.struct(F.col("id").isNull().alias("absent"), "id", "no"), bits)
    stays = found.select(F.col("head.no").alias("no")).distinct()
    stays = saved(stays, "simhash-stays").hint("merge")  # as many as documents: never broadcast, whatever the size today
    return rows.join(stays, "no", "left_semi").select("row.*")
