"""SentencePiece encoding and decoding (BPE models) by a table of last tokens.

Of every prefix of a text the encoding has one last token, and prefixes of an encoding are encodings: so the table needs one token
per position. At a position an automaton over the vocabulary gives all tokens that end there; the last token is the one that
encodes to itself and is compatible with the last token of the prefix before it. Ids are then recovered backwards. The work is
linear in the text, whatever its words.

Two tokens are compatible if encoding their joined text gives them back. A token's own merges are known, so the symbols at its
edge and the times at which they are made and consumed are, too: a pair is incompatible if some piece could join the symbols of
both edges while both exist. Of merges of equal score the leftmost comes first. Pieces whose parts merge after their own score
would let them (runs of spaces) are tested by merging the joined text itself. All answers are remembered.

No piece holds a space after another character, so a text is cut before every run of spaces, and units seen before come from a
table of bounded size per Python worker. Characters outside the vocabulary become bytes.

Defined results: null text is empty and has no ids; very long texts are encoded whole; repeated rows encode alike; other columns
are not read. Models without byte fallback, or with user-defined or unused pieces or a normal form, are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import grouped

SPACE = "▁"  # fixed: how pieces write a space
KNOWN = 1 << 24  # characters of remembered units per worker; dropped together when there are more
LONGEST = 64  # longer units are not remembered
NEVER = float("inf")


class Pieces:
    """A model file: its pieces and scores; merging and the table of last tokens are done here."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kind = model.SentencePiece
        form = model.normalizer_spec
        plain = form.add_dummy_prefix and form.escape_whitespaces and not form.remove_extra_whitespaces and not form.precompiled_charsmap
        if model.trainer_spec.model_type != model.trainer_spec.BPE or model.trainer_spec.treat_whitespace_as_suffix or not plain:
            raise ValueError("a BPE model with a dummy prefix and without a normal form is needed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces) or not model.trainer_spec.byte_fallback:
            raise ValueError("a model with byte fallback and without user-defined or unused pieces is needed")
        self.library = SentencePieceProcessor(model_file=path)
        self.texts = [p.piece for p in model.pieces]
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.times = {p.piece: -p.score for p in model.pieces if p.type == kind.NORMAL}  # the best score merges first
        self.bytes = {int(p.piece[3:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kind.BYTE}
        #: what a token stands for in a text; None: left to the library
        self.values: list[bytes | None] = [p.piece.replace(SPACE, " ").encode() if p.type == kind.NORMAL else None for p in model.pieces]
        for value, k in self.bytes.items():
            self.values[k] = bytes([value])
        self.decimals = [str(k).encode() for k in range(len(self.texts))]
        self.automaton = ahocorasick.Automaton()
        for piece, k in self.ids.items():
            self.automaton.add_word(piece, (k, len(piece)))
        self.automaton.make_automaton()
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.unit = re.compile("(?s).+" if inner else f"{SPACE}+[^{SPACE}]*")
        self.edges: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.room = KNOWN

    def merge(self, text: str) -> list[tuple]:
        """The model's merges of a short text, one by one: trees (piece, time made, left, right) of the symbols that remain."""
        row: list[tuple] = [(c, 0.0, None, None) for c in text]
        while True:
            joined = [(self.times[a[0] + b[0]], k) for k, (a, b) in enumerate(zip(row, row[1:])) if a[0] + b[0] in self.times]
            if not joined:
                return row
            time, k = min(joined)
            a, b = row[k:k + 2]
            row[k:k + 2] = [(a[0] + b[0], max(time, a[1], b[1]), a, b)]

    def edge(self, token: int) -> tuple | None:
        """Whether its parts may merge late, and (symbol, made, consumed) of its left and right edge; None if it does not encode to itself."""
        if token not in self.edges:
            trees = self.merge(self.texts[token])
            late, sides = False, []
            stack = list(trees)
            while stack:
                piece, made, left, right = stack.pop()
                if left:
                    late |= self.times[piece] < made
                    stack += [left, right]
            for child in (2, 3):
                node, consumed, side = trees[0], NEVER, []
                while node:
                    side.append((node[0], node[1], consumed))
                    consumed, node = node[1], node[child]
                sides.append(side)
            self.edges[token] = (late, *sides) if len(trees) == 1 else None
        return self.edges[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``."""
        key = a * len(self.texts) + b
        if (known := self.pairs.get(key)) is None:
            known = self.pairs[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        first, second = self.edge(a), self.edge(b)
        if first is None or second is None:
            return False
        if first[0] or second[0]:
            return [t[0] for t in self.merge(self.texts[a] + self.texts[b])] == [self.texts[a], self.texts[b]]
        for x, made_x, gone_x in first[2]:
            for y, made_y, gone_y in second[1]:
                time = self.times.get(x + y)
                if time is not None and (at := max(time, made_x, made_y)) < gone_x and at <= gone_y:
                    return False
        return True

    def last_tokens(self, unit: str) -> list[int]:
        """The last token of every prefix; -1 where a character outside the vocabulary ends."""
        last = [-1] * len(unit)
        for end, (token, length) in self.automaton.iter(unit):
            if last[end] < 0:
                before = last[end - length] if length <= end else -1  # nothing merges with an unknown character
                if self.fits(before, token) if before >= 0 else self.edge(token) is not None:
                    last[end] = token
        return last

    def encode_unit(self, unit: str) -> bytes:
        last, ids, at, texts = self.last_tokens(unit), [], len(unit), self.texts
        while at:
            token = last[at - 1]
            if token < 0:
                ids += [self.bytes[b] for b in reversed(unit[at - 1].encode())]
                at -= 1
            else:
                ids.append(token)
                at -= len(texts[token])
        return np.array(ids[::-1], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, each as little-endian unsigned 32-bit integers."""
        if self.room < 0:
            self.known.clear()
            self.room = KNOWN
        known, out = self.known, []
        for text in texts:
            units = self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []
            try:
                out.append(b"".join(map(known.__getitem__, units)))
            except KeyError:
                parts = []
                for unit in units:
                    if (ids := known.get(unit)) is None:
                        ids = self.encode_unit(unit)
                        if len(unit) <= LONGEST:
                            known[unit] = ids
                            self.room -= len(unit)
                    parts.append(ids)
                out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; what holds broken bytes or special tokens goes by the library's rules."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            text = b"".join(map(self.values.__getitem__, numbers)).decode()
        except (TypeError, UnicodeDecodeError):
            return self.library.decode(numbers)
        return text[1:] if numbers and self.texts[numbers[0]].startswith(SPACE) else text

    def decimal(self, ids: bytes) -> bytes:
        """Decimal ids joined by commas."""
        return b",".join(map(self.decimals.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """The model, once per Python worker."""
    return Pieces(path)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, make) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            at = 0
            for texts in grouped(t.as_py() for t in batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *make(model, model.encode(texts))], names=names)
                at += len(texts)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) of every row."""
    return _mapped(docs, path, id_col, text_col, "ids binary", lambda model, ids: [pa.array(ids, pa.binary())])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the decoded ``text``."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x.as_py() or b"") for x in batch.column(1)], pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of both directions without moving ids or decoded texts between processes."""

    def digests(model: Pieces, ids: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([sha256(model.decimal(x)).hexdigest() for x in ids], pa.string()),
            pa.array([sha256(model.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        ]

    return _mapped(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
