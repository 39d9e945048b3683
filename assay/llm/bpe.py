"""Byte-pair encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array. A round forms every neighbouring pair, looks its rank up by binary search in
the sorted pair keys of the merge table, finds the lowest rank of each word, and merges that pair, left to right, in all words at
once. Rounds go on until no word has a mergeable pair. Words over ``LONG`` letters have many different ranks, so they keep their pairs in
lists by rank: a round takes the lowest rank, merges its pairs at all places of the word, and files the new pairs, so its work follows
the merges and not the length of the word.

A text is split at single spaces first. That is safe here as the tokenizer's pattern never joins characters over white space and
its normal forms do not compose with a space. Pieces seen before come from a table of bounded size per Python worker, so merging
works on new pieces only. Special tokens in a text are cut out first and become their ids, as the tokenizers library does.

Defined results: null text is empty and has no ids; very long texts are encoded whole; repeated rows encode alike; other
columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KNOWN = 400_000  # pieces remembered per worker, and dropped together when there are more
HELD = 64 << 20  # the same for their letters
LONG = 256  # letters; longer words are merged by rank lists
PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 \\t\\n\\x0b\\x0c\\r]+")  # the pattern of the file, on lower-case ASCII

PRINTED = re.compile("[\\t-\\r -~]*")


class Bpe:
    """The tokenizer of a file: vocabulary and merges here, normal form and splitting by the library for non-ASCII pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, k in [*self.vocab.items(), *self.specials.items()]:
            self.tokens[k] = token
        self.size = size
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0  # letters of the pieces remembered

    def pieces(self, chunk: str) -> list[str]:
        """Words of a piece of text without plain spaces, in the alphabet of the vocabulary."""
        if PRINTED.fullmatch(chunk):
            return PLAIN.findall(chunk.lower())  # such characters stand for themselves in the byte alphabet
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of every word, as little-endian unsigned 32-bit integers; all short words at once."""
        long = {i for i, w in enumerate(words) if len(w) > LONG}
        if long:
            short = iter(self.merge([w for i, w in enumerate(words) if i not in long]))
            return [self.merge_long(w) if i in long else next(short) for i, w in enumerate(words)]
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        vocab, suffix = self.vocab, self.suffix
        flat = np.array([vocab[c] for w in words for c in w], np.int64)
        ends = np.cumsum(lengths) - 1
        if suffix:
            flat[ends] = [vocab[w[-1] + suffix] for w in words]
        word = np.repeat(np.arange(len(words)), lengths)
        out_ids, out_words = [], []
        none = len(self.merged)
        while len(flat):
            key = flat[:-1] * self.size + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            span = np.diff(np.r_[starts, len(flat)])
            done = np.repeat(best == none, span)
            if done.any():  # finished words leave the array
                out_ids.append(flat[done])
                out_words.append(word[done])
                flat, word, rank = flat[~done], word[~done], rank[~done]
                best, span = best[best < none], span[best < none]
                if not len(flat):
                    break
            hit = rank == np.repeat(best, span)
            # of overlapping equal pairs (aaa) only every second merges, counted from the left of its run
            follows = np.r_[False, hit[1:] & hit[:-1]]
            if follows.any():
                index = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~follows, index, 0))
                hit &= (index - first) % 2 == 0
            flat = np.where(hit, self.merged[np.minimum(rank, none - 1)], flat)
            keep = ~np.r_[False, hit[:-1]]
            flat, word = flat[keep], word[keep]
        ids, owner = np.concatenate(out_ids), np.concatenate(out_words)
        blob = ids[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()]
        return [blob[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, word: str) -> bytes:
        """Ids of one long word. Symbols are linked to their neighbours; ``todo`` holds the places of pairs by rank.

        A place is looked at again when its rank comes up, so pairs that have changed since are passed over.
        """
        flat = np.array([self.vocab[c] for c in word], np.int64)
        if self.suffix:
            flat[-1] = self.vocab[word[-1] + self.suffix]
        n = len(flat)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: none
        alive = np.ones(n, bool)
        todo: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places that begin a mergeable pair, and its rank."""
            places = places[after[places] < n]
            key = flat[places] * self.size + flat[after[places]]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            return places[good], self.ranks[at[good]]

        def file(places: np.ndarray) -> None:
            places, rank = look(places)
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for r, some in zip(rank[cuts].tolist() if len(rank) else [], np.split(places, cuts[1:]) if len(rank) else []):
                if r not in todo:
                    todo[r] = []
                    heappush(ranks, r)
                todo[r].append(some)

        file(np.arange(n))
        while ranks:
            r = heappop(ranks)
            places = np.unique(np.concatenate(todo.pop(r)))
            places, found = look(places[alive[places]])
            places = places[found == r]
            if not len(places):
                continue
            # of overlapping equal pairs only every second merges, counted from the left of its run
            follows = np.r_[False, after[places[:-1]] == places[1:]]
            if follows.any():
                index = np.arange(len(places))
                places = places[(index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0]
            gone = after[places]
            flat[places], alive[gone] = self.merged[r], False
            after[places] = after[gone]
            right = after[places]
            inside = right < n
            before[right[inside]] = places[inside]
            left = before[places]
            file(np.unique(np.r_[left[left >= 0], places]))
        return flat[alive].astype("<u4").tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Encodes pieces that the table does not hold yet."""
        lists = [self.pieces(c) for c in chunks]
        ids = self.words
        words = list({w for ws in lists for w in ws if w not in ids})
        ids.update(zip(words, self.merge(words)))
        self.held += sum(map(len, chunks))
        for chunk, ws in zip(chunks, lists):
            self.known[chunk] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, each as little-endian unsigned 32-bit integers."""
        if len(self.known) > KNOWN or len(self.words) > KNOWN or self.held > HELD:
            self.known.clear()
            self.words.clear()
            self.held = 0
        marks = list(self.specials)
        split = [self.special.split(t) if t and any(m in t for m in marks) else [t or ""] for t in texts]
        chunks = [[part.split(" ") if k % 2 == 0 else part for k, part in enumerate(parts)] for parts in split]
        known = self.known
        new = {c for parts in chunks for part in parts if isinstance(part, list) for c in part if c not in known}
        if new:
            self.learn(list(new))
        get = known.__getitem__
        special = {s: k.to_bytes(4, "little") for s, k in self.specials.items()}
        return [b"".join([b"".join(map(get, part)) if isinstance(part, list) else special[part] for part in parts]) for parts in chunks]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces, which is what the library does for a file without a decoder; specials stay."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The tokenizer, once per Python worker."""
    return Bpe(path)


def grouped(values: list, limit: int = 1 << 20) -> Iterator[list]:
    """Runs of texts of about ``limit`` characters, so that memory does not follow the Arrow batch."""
    run, size = [], 0
    for value in values:
        run.append(value)
        size += len(value or "")
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) of every row."""
    return _mapped(docs, path, id_col, text_col, "ids binary", lambda bpe, ids: [pa.array(ids, pa.binary())], ["ids"])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the decoded ``text``."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x.as_py() or b"") for x in batch.column(1)], pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of both directions without moving ids or decoded texts between processes."""
    from hashlib import sha256

    def digests(bpe: Bpe, ids: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        ]

    return _mapped(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, make, names: list[str]) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at = 0
            for texts in grouped((t.as_py() for t in batch.column(1))):
                columns = make(bpe, bpe.encode(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names=["id", *names])
                at += len(texts)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)
