"""Alignment of two tokenizers' tokens by merging their token ends in lockstep.

Both token lists of a text cover the same bytes. Walking both at once, the list whose current token ends first moves on; where both
end together the text is cut, and the tokens since the last cut form a group. All texts of a run walk together: one state vector holds
the pointers of every text, each step moves them all, emits the cuts reached and the links of every token just entered with the other
side's tokens of its open group, and drops the lanes that have ended. A long text enters as several lanes, parted at ends that both
lists share, so a run takes as many steps as a lane has tokens.

How many documents hold a pair of ids linked is counted over all of them: documents are written with their different pairs, in batches of
bounded size; pairs are added up per batch before they move, summed over batches, and only the pairs a batch asks for go back to it.

Defined results: null and empty texts, and texts whose tokens' joined bytes are not the space and the text on either side (as with
U+2581 in the text), have no tokens: zeros and an empty digest; null or repeated ids keep their rows, and each row counts as a document;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing, pieces
from ._shared import saved
from .bpe import grouped

LANE = 256  # tokens of the first list after which a long text may be parted
RUN = 1 << 20  # characters that walk together
BATCH = 8  # runs whose pairs are asked for together
LEFT = "batch long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Sides:
    """Both tokenizers, the bytes of their tokens, and the strings of the digest."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = packing.load(path_a), pieces.load(path_b)
        coder = self.a.coder
        self.bytes_a = {k: coder.decode_single_token_bytes(k) for k in range(coder.n_vocab) if self._holds(coder, k)}
        self.size_a, self.size_b = max(self.bytes_a) + 1, len(self.b.texts)
        self.lengths_a = np.array([len(self.bytes_a.get(k, b"")) for k in range(self.size_a)], np.int64)
        self.lengths_b = np.array([len(v or b"") for v in self.b.values], np.int64)
        #: an id and what stands behind it: within a group, after its first list, after the group
        written = [f"{k}{end}".encode() for end in ",|" for k in range(self.size_a)] + [f"{k}{end}".encode() for end in ",;" for k in range(self.size_b)]
        self.written = np.empty(len(written), object)
        self.written[:] = written
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}

    @staticmethod
    def _holds(coder, token: int) -> bool:
        try:
            coder.decode_single_token_bytes(token)
        except KeyError:
            return False
        return True

    def _learn(self, parts: list[str]) -> bool:
        """Ids of the words between single spaces, each with its space; words that may not be encoded alone are not learned."""
        if len(self.known_a) > packing.KNOWN:
            self.known_a.clear()
            self.known_b.clear()
        for part in parts:
            if part not in self.known_a:
                if not part or part != part.strip() or pieces.SPACE in part:
                    return False
                self.known_a[part] = self.a._ids(" " + part)
                self.known_b[part] = self.b.encode_unit(pieces.SPACE + part)
        return True

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none unless both join to the space and the text. Both start a token at every space before a word, so words
        between single spaces are encoded alone; a text with other white space goes as a whole."""
        nothing = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        if not text or pieces.SPACE in text:  # the second side reads its own space sign as a space
            return nothing
        parts = text.split(" ")
        try:
            raw = [b"".join(map(known.__getitem__, parts)) for known in (self.known_a, self.known_b)]
        except KeyError:
            if self._learn(parts):
                raw = [b"".join(map(known.__getitem__, parts)) for known in (self.known_a, self.known_b)]
            else:
                raw = [self.a._ids(" " + text), self.b.encode([text])[0]]
        a, b = (np.frombuffer(x, "<u4") for x in raw)
        size = 1 + len(text.encode())
        return (a, b) if self.lengths_a[a].sum() == size == self.lengths_b[b].sum() else nothing


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Token indices of both lists at which the lanes of one text end: shared ends, ``lane`` or more tokens apart, and the last."""
    at_a, at_b, k = [], [], lane
    while k < len(ends_a) - 1:
        look = ends_a[k:k + lane]
        there = np.searchsorted(ends_b, look)
        hit = np.flatnonzero(ends_b[np.minimum(there, len(ends_b) - 1)] == look)
        if len(hit) and k + hit[0] < len(ends_a) - 1:
            at_a.append(k + int(hit[0]) + 1)
            at_b.append(int(there[hit[0]]) + 1)
            k = at_a[-1] + lane
        else:
            k += lane
    return np.array([*at_a, len(ends_a)], np.int64), np.array([*at_b, len(ends_b)], np.int64)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, stop_a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Walks all lanes at once. Returns the last token of both lists at every cut, and the links as token indices of both lists."""
    a, b, stop = first_a.copy(), first_b.copy(), stop_a
    open_a, open_b = first_a.copy(), first_b.copy()  # first tokens of the open group
    cuts_a, cuts_b, links_a, links_b = [], [], [first_a], [first_b]
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        cut, on_a = end_a == end_b, end_a <= end_b
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        a, b = a + on_a, b + (end_b <= end_a)
        open_a, open_b = np.where(cut, a, open_a), np.where(cut, b, open_b)
        ended = cut & (a == stop)
        if ended.any():
            a, b, stop, open_a, open_b, on_a = (x[~ended] for x in (a, b, stop, open_a, open_b, on_a))
        # the token just entered, with all tokens that its group holds on the other side
        others = np.where(on_a, b - open_b, a - open_a) + 1
        if (others == 1).all():
            links_a.append(a)
            links_b.append(b)
        else:
            lane = np.repeat(np.arange(len(a)), others)
            step = np.arange(len(lane)) - np.repeat(np.cumsum(others) - others, others)
            links_a.append(np.where(on_a[lane], a[lane], open_a[lane] + step))
            links_b.append(np.where(on_a[lane], open_b[lane] + step, b[lane]))
    # cuts of one lane come in order, lanes do not: token indices rise together on both sides
    cuts = np.sort(np.concatenate(cuts_a or [first_a])), np.sort(np.concatenate(cuts_b or [first_b]))
    return *cuts, np.concatenate(links_a), np.concatenate(links_b)


def align(sides: Sides, texts: list[str | None]) -> dict[str, pa.Array]:
    """Counts, digest and different pairs (with how often) of every text of a run."""
    ids = [sides.tokens(t) for t in texts]
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    flat_a, flat_b = (np.concatenate([x[k] for x in ids]).astype(np.int64) for k in (0, 1))
    base_a, base_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
    sums_a, sums_b = np.r_[0, np.cumsum(sides.lengths_a[flat_a])], np.r_[0, np.cumsum(sides.lengths_b[flat_b])]
    ends_a, ends_b = sums_a[1:], sums_b[1:]  # of the whole run: both sides of a text cover the same bytes
    first_a, first_b, stop_a = [], [], []
    for k in np.flatnonzero(n_a):
        p, q, r, s = base_a[k], base_a[k + 1], base_b[k], base_b[k + 1]
        at_a, at_b = lanes(ends_a[p:q], ends_b[r:s]) if q - p > 2 * LANE else (np.array([q - p]), np.array([s - r]))
        first_a.append(np.r_[p, p + at_a[:-1]])
        first_b.append(np.r_[r, r + at_b[:-1]])
        stop_a.append(p + at_a)
    nothing = [np.zeros(0, np.int64)]
    cuts_a, cuts_b, link_a, link_b = lockstep(ends_a, ends_b, *(np.concatenate(x or nothing) for x in (first_a, first_b, stop_a)))

    every = np.arange(len(texts))
    doc_of = np.repeat(every, n_a)  # of the first side's tokens
    n_groups = np.bincount(doc_of[cuts_a], minlength=len(texts))
    # digest: the first list's tokens of a group stand before the second's
    last_a, last_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
    last_a[cuts_a], last_b[cuts_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    line = np.zeros(len(flat_a) + len(flat_b), np.int64)
    line[np.arange(len(flat_a)) + np.r_[0, cuts_b + 1][group_a]] = flat_a + sides.size_a * last_a
    line[np.arange(len(flat_b)) + np.r_[cuts_a + 1, 0][group_b]] = 2 * sides.size_a + flat_b + sides.size_b * last_b
    written = sides.written[line]
    places = (base_a + base_b).tolist()
    digests = [sha256(b"".join(written[p:q].tolist())[:-1]).hexdigest() if q > p else "" for p, q in zip(places, places[1:])]
    # different pairs of every text, and how often each is linked
    size = sides.size_a * sides.size_b
    key = np.sort(doc_of[link_a] * size + flat_a[link_a] * sides.size_b + flat_b[link_b])
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.r_[starts, len(key)])
    doc, pair = np.divmod(key[starts], size)
    n_links = np.bincount(doc, times, len(texts)).astype(np.int64)
    cuts = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
    return {
        "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups.astype(np.int64)),
        "n_links": pa.array(n_links), "groups_sha256": pa.array(digests, pa.string()),
        "pairs": pa.ListArray.from_arrays(cuts, pa.array(pair)), "times": pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
    }


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's batch, counts, digest and different linked pairs (first id x size of the second vocabulary + second id)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, turn, part = load(path_a, path_b), 0, TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            for texts in grouped((t.as_py() for t in batch.column(1)), RUN):
                found = align(sides, texts)
                number = pa.array(np.full(len(texts), (part << 32) + turn // BATCH, np.int64))
                yield pa.RecordBatch.from_arrays([number, batch.column(0).slice(at, len(texts)), *found.values()], names=["batch", "id", *found])
                at += len(texts)
                turn += 1

    return rows.mapInArrow(run, LEFT.format(kind=rows.schema["id"].dataType.simpleString()))


def pair_counts(docs: DataFrame, size_b: int) -> tuple[DataFrame, DataFrame]:
    """Of ``aligned`` rows: the pairs every batch asks for, and of every pair ``docs`` (documents that hold it) and ``best`` (whether that is
    the highest of its first id)."""
    asked = saved(docs.select("batch", F.explode("pairs").alias("pair")).groupBy("batch", "pair").agg(F.count(F.lit(1)).alias("docs")), "align-asked")
    counts = saved(asked.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"pair div {size_b}L")), "align-counts")
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return asked, counts.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def token_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens of both sides, groups, links, links whose pair is its first id's commonest, the sum of the links' counts,
    and the digest of the groups."""
    size_b = len(pieces.load(path_b).texts)
    rows = saved(aligned(docs, path_a, path_b, id_col, text_col), "align-rows")
    asked, counts = pair_counts(rows, size_b)
    answers = asked.select("batch", "pair").join(counts.hint("merge"), "pair")
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        known = right["pair"].to_numpy()
        order = np.argsort(known)
        lists = left["pairs"].combine_chunks()
        pair, times = lists.flatten().to_numpy(), left["times"].combine_chunks().flatten().to_numpy()
        at = order[np.searchsorted(known[order], pair)]
        bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        sums = [np.r_[0, np.cumsum(times * right[c].to_numpy()[at].astype(np.int64))] for c in ("best", "docs")]
        found = [pa.array(x[bounds[1:]] - x[bounds[:-1]], pa.int64()) for x in sums]
        return pa.table([*(left[c] for c in kept), *found], names=[*kept, "n_best", "count_sum"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    found = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(add, schema)
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
