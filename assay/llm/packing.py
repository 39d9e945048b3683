"""Packing by concatenate and cut.

Pass one turns every document into token ids, ends it with the separator, and writes ids, length and the number of tokens that
stand before it in its own partition. Totals per partition, one row each, are summed up in order: that gives every partition its
global offset, and every document its own. Pass two cuts the documents where the global position crosses a multiple of the window
and returns one boundary record per piece. Nothing but the totals is ever sorted, and only the very last sequence can be short.

The written table fixes the order, so a lost executor cannot move a token. Pieces fill sequences without a gap.

Defined results: a null text is empty and takes its separator only; null or repeated ids are packed row by row; a document
longer than a window spans as many as it needs; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import saved
from .bpe import grouped

WINDOW = 1024
END = 0
KNOWN = 400_000  # pieces remembered per worker


class ByteBpe:
    """Ids of a byte-level tokenizer file. Ranks are the vocabulary's ids; pieces between single spaces are remembered."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = self.alphabet()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.specials}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the byte-level split
        self.coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.known: dict[str, bytes] = {}

    @staticmethod
    def alphabet() -> dict[str, int]:
        """Byte of every character that the file writes for one: printable ones stand for themselves, others from 256 on."""
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printed]
        return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(rest)}

    def _ids(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        """A piece starts at every single space, so each can be encoded alone; a text with longer white space goes as a whole."""
        if len(self.known) > KNOWN:
            self.known.clear()
        known, (first, *rest) = self.known, text.split(" ")
        if first != first.strip() or not first:
            return self._ids(text)
        try:
            tail = b"".join(map(known.__getitem__, rest))
        except KeyError:
            for piece in rest:
                if piece not in known:
                    if not piece or piece != piece.strip():
                        return self._ids(text)
                    known[piece] = self._ids(" " + piece)
            tail = b"".join(map(known.__getitem__, rest))
        return self._ids(first) + tail

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens in the text become their ids."""
        text = text or ""
        if not self.special or "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(self._plain(p) if k % 2 == 0 else self.specials[p].to_bytes(4, "little") for k, p in enumerate(parts))


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Pass one, lazily: id, part, before (tokens of the partition ahead), n, ids (little-endian, 16 bits where all fit)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, before = load(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in grouped(t.as_py() for t in batch.column(1)):
                ids = [np.append(np.frombuffer(bpe.encode(t), "<u4"), np.uint32(end)) for t in texts]
                n = np.array([len(x) for x in ids], np.int64)
                small = [x.astype("<u2") if x.max() < 1 << 16 else x for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(np.full(len(n), part)), pa.array(before + np.cumsum(n) - n), pa.array(n),
                     pa.array([x.tobytes() for x in small], pa.binary())],
                    names=["id", "part", "before", "n", "ids"])
                before += int(n.sum())
                at += len(texts)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, part long, before long, n long, ids binary")


def offsets(written: DataFrame) -> DataFrame:
    """Tokens ahead of every partition: prefix sums over one row per partition, whatever the number of documents."""
    totals = written.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(ahead, F.lit(0)).alias("base"))


def pieces(placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pass two: boundary records of documents with their global ``position``."""
    rows = placed.select("id", "position", "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            owner: list[int] = []
            for k, (position, n, raw) in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)])):
                ids = memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes())
                start = 0
                while start < n:
                    sequence, offset = divmod(position + start, window)
                    length = min(window - offset, n - start)
                    out.append((start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), n, sequence, offset, start > 0, start + length < n))
                    owner.append(k)
                    start += length
            names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continued", "continues"]
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
            columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names=["id", *names])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, " \
             "sequence_id long, offset long, continued boolean, continues boolean"
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One boundary record per piece: where it lies in its document and in its sequence, and a checksum of its ids."""
    written = saved(tokens(docs, path, id_col, text_col, end), "pack-tokens")
    ahead = saved(offsets(written), "pack-offsets")  # one row per partition: Spark broadcasts it while it is small
    placed = written.join(ahead, "part").select("id", (F.col("base") + F.col("before")).alias("position"), "n", "ids")
    return pieces(placed, window).withColumnRenamed("id", id_col)
