"""Stupid-backoff scores from the corpus's own n-gram counts.

For a word with its context, S = c(context word) / c(context) if the n-gram was counted at least ``min_count`` times, else ``backoff``
times the S of the context without its first word, down to c(word) / N. A document's score is the sum of log S over its words.
Contexts at the start of a document are as long as there is text. All counts cover all documents.

Relations: documents become batches of some hundred thousand words (written once: word numbers and a table of word hashes). For
each order, every batch yields its distinct n-grams with their counts, cut by hash into partitions; a partition adds up the counts
of equal n-grams, which is the count table, and sends each batch the totals of what it asked for. Joined back to their batch, the totals
give every word its S, and these are summed per document. An n-gram crosses the network once per batch whatever its number of
copies, so a frequent one is no hot key; partitions grow in number with the corpus, not in size.

Words are compared by 48 bits of a hash, n-grams by 40 bits of a hash besides those that pick the partition. As partitions grow in number with the corpus, the
chance that an n-gram meets another one of the same bits stays below one in a million. Words are ASCII-lower-cased runs without
ASCII white space. Defined results: a document without a word (null, empty) has n_words 0 and score 0.0 and a null mean; null or
repeated ids keep their rows; an empty table gives an empty result; other columns are not read; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import saved

ORDER = 3
MIN_COUNT = 2
BACKOFF = 0.4
BATCH_WORDS = 500_000
PARTITION_KEYS = 1 << 20  # words of the corpus per partition of a count table
WORD_BYTES = 6  # of a word's hash
KEPT = 5  # bytes of a hash that travel
BATCH = "batch long, ids array<{kind}>, lengths binary, words binary, vocab binary"


def batches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BATCH_WORDS) -> DataFrame:
    """Runs of documents as numbered words, a row each; a document is never cut."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        lists: list[list[bytes]] = []
        total = 0

        def row() -> pa.RecordBatch:
            place: dict[bytes, int] = {}
            flat = [place.setdefault(w, len(place)) for ws in lists for w in ws]
            vocab = np.fromiter((xxhash.xxh64_intdigest(w) for w in place), np.uint64, len(place))
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(stream_type)), pa.array([np.array([len(ws) for ws in lists], "<i8").tobytes()], pa.binary()),
                pa.array([_planes(np.array(flat, np.int64), 4)], pa.binary()), pa.array([_planes(vocab, WORD_BYTES)], pa.binary())],
                names=["batch", "ids", "lengths", "words", "vocab"])

        for part in stream:
            stream_type = part.schema.field(0).type
            for key, text in zip(part.column(0), part.column(1)):
                words = (text.as_py() or "").encode().lower().split()
                ids.append(key.as_py())
                lists.append(words)
                total += len(words) + 1
                if total >= size:
                    yield row()
                    ids, lists, total, number = [], [], 0, number + 1
        if ids:
            yield row()

    return rows.mapInArrow(run, BATCH.format(kind=kind))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, order included."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ngrams(words: bytes, vocab: bytes, lengths: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per order the hash of the n-gram that ends at each word (of order n only where ``index`` >= n - 1), the index of each word
    in its document, and the lengths."""
    lengths_ = np.frombuffer(lengths, "<i8")
    one = _numbers(vocab, WORD_BYTES)[_numbers(words, 4).astype(np.int64)]
    index = np.arange(len(one)) - np.repeat(np.cumsum(lengths_) - lengths_, lengths_)
    hashes = [_mix(one, np.full_like(one, 1))]
    for n in range(2, order + 1):
        before = np.r_[np.zeros(1, np.uint64), hashes[-1][:-1]][:len(one)]
        hashes.append(_mix(_mix(before, one), np.full_like(one, n)))
    return hashes, index, lengths_


def _planes(values: np.ndarray, size: int) -> bytes:
    """Bytes of the same weight side by side, which compresses sorted and small numbers well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _numbers(planes: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(planes) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(planes, np.uint8).reshape(size, -1).T
    return out.view("<u8").ravel()


def requests(tokens: DataFrame, bits: int, order: int) -> DataFrame:
    """Distinct n-grams of one order in every batch with their counts there, by partition of the hash."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in stream:
            for i in range(part.num_rows):  # one at a time, as a row holds a whole batch
                batch, lengths, words, vocab = (part.column(k)[i].as_py() for k in range(4))
                hashes, index, _ = ngrams(words, vocab, lengths, order)
                keys, counts = np.unique(hashes[-1][index >= order - 1], return_counts=True)
                home = (keys >> np.uint64(64 - bits)).astype(np.int64)
                rest = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * KEPT)  # the next bits, so still in order
                used, starts = np.unique(home, return_index=True)
                cuts = [*starts.tolist(), len(keys)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int64()), pa.array([batch] * len(used), pa.int64()),
                    pa.array([_planes(rest[a:b], KEPT) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([_planes(counts[a:b], 4) for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["home", "batch", "keys", "counts"])

    return tokens.select("batch", "lengths", "words", "vocab").mapInArrow(run, "home long, batch long, keys binary, counts binary")


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    """The count table of one partition, answered batch by batch."""
    keys = [_numbers(k, KEPT) for k in group["keys"]]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_numbers(c, 4) for c in group["counts"]]).astype(np.int64)
    total = np.zeros(place.max() + 1, np.int64)
    np.add.at(total, place, counts)
    cuts = np.cumsum([0, *map(len, keys)])
    return pd.DataFrame({"batch": group["batch"], "home": group["home"], "totals": [_planes(total[place[a:b]], 8) for a, b in zip(cuts, cuts[1:])]})


def _log_scores(counts: list[np.ndarray], index: np.ndarray, n_all: int, min_count: int, backoff: float) -> np.ndarray:
    """log S of every word from the totals of the n-grams that end there (0 where there is none)."""
    order = len(counts)
    out = np.log(counts[0]) - np.log(n_all) + np.log(backoff) * np.minimum(index, order - 1)
    for n in range(1, order):  # longer n-grams replace shorter ones where they are counted
        use = (index >= n) & (counts[n] >= min_count)
        at = np.flatnonzero(use)
        out[at] = np.log(counts[n][at]) - np.log(counts[n - 1][at - 1]) + np.log(backoff) * (np.minimum(index[at], order - 1) - n)
    return out


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """``id_col``, ``n_words``, ``score`` (sum of log S) and ``mean_score`` of every document."""
    tokens = saved(batches(docs, id_col, text_col), "lm-batches")
    n_bytes = tokens.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0
    n_all = max(1, n_bytes // 4)
    bits = max(8, int(np.ceil(np.log2(max(1, n_all / PARTITION_KEYS)))))
    tables = []
    for n in range(1, order + 1):  # one count table after the other, so that the exchange of one order is gone before the next
        asked = requests(tokens, bits, n).groupBy("home").applyInPandas(_totals, "batch long, home long, totals binary")
        tables.append(saved(asked.withColumn("n", F.lit(n)), "lm-totals"))
    totals = reduce(DataFrame.unionByName, tables)
    kind = tokens.schema["ids"].dataType.elementType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        hashes, index, lengths = ngrams(row["words"], row["vocab"], row["lengths"], order)
        counts = []
        for n in range(order):
            have, column = index >= n, np.zeros(len(index))
            if have.any():
                _, place = np.unique(hashes[n][have], return_inverse=True)
                answers = right[right["n"] == n + 1].sort_values("home")["totals"]  # partitions are runs of the sorted n-grams
                column[have] = np.concatenate([_numbers(t, 8) for t in answers])[place]
            counts.append(column)
        logs = np.r_[0.0, np.cumsum(_log_scores(counts, index, n_all, min_count, backoff))]
        ends = np.cumsum(lengths)
        score = logs[ends] - logs[ends - lengths]
        return pd.DataFrame({"id": pd.Series(list(row["ids"]), dtype=object), "n_words": lengths, "score": np.where(lengths > 0, score, 0.0)})

    joined = tokens.groupBy("batch").cogroup(totals.groupBy("batch")).applyInPandas(run, f"id {kind}, n_words long, score double")
    mean = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))
    return joined.select(F.col("id").alias(id_col), "n_words", "score", mean.alias("mean_score"))
