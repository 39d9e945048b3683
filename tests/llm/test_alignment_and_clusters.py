"""Operators 11 to 13 against the libraries and brute force."""

from __future__ import annotations

import math
import random
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import alignment, lloyd, pieces
from assay.llm.queries import QUERIES, tokenizer
from conftest_data import EDGE

BYTES, PIECES = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
MODEL = pieces.load(PIECES)


@pytest.fixture(scope="module")
def texts(small):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())


# --- 13: SentencePiece ----------------------------------------------------------


def same_as_library(text: str) -> None:
    ids = np.frombuffer(MODEL.encode([text])[0], "<u4").tolist()
    assert ids == MODEL.library.encode(text)
    assert MODEL.decode(np.array(ids, "<u4").tobytes()) == MODEL.library.decode(ids)


def test_piece_query(spark, small, texts):
    rows = QUERIES["op13_piece_round_trip"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = MODEL.library.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(MODEL.library.decode(ids).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("abeinrst ▁é\n0", max_size=40) | st.lists(st.sampled_from(sorted(MODEL.ids)), max_size=8).map("".join))
def test_pieces_of_any_text(text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        same_as_library(text)


@pytest.mark.parametrize("text", ["", " ", "<s></s><unk><0x41>", *[" " * n + t for n in (2, 3, 15, 16, 17, 31, 47, 100) for t in ("", "a", "文")], "a" * 777, "\x00\U0001f600﻿" * 20])
def test_odd_pieces(text):
    same_as_library(text)


def test_a_very_long_word_is_linear():
    draw = random.Random(3)
    same_as_library("".join(draw.choices("abcdefghijklmnop0123456789+/", k=200_000)) + " " * 100_000)


def test_broken_bytes_decode_as_in_the_library():
    for ids in ([0, 1, 2], [3 + 0xE6, 3 + 0x96], [3 + 0xFF, 500, 3 + 0x41], [261, 2, 262]):
        assert MODEL.decode(np.array(ids, "<u4").tobytes()) == MODEL.library.decode(ids)


def test_piece_edges(edge, none):
    rows = pieces.encode(edge, PIECES).collect()
    want = Counter((d, np.array(MODEL.library.encode(t or ""), "<u4").tobytes()) for d, t, _, _ in EDGE)
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    back = pieces.decode(pieces.encode(edge, PIECES), PIECES).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, MODEL.library.decode(MODEL.library.encode(t or ""))) for d, t, _, _ in EDGE)
    assert pieces.round_trip(none, PIECES).count() == 0


# --- 11: alignment --------------------------------------------------------------


def brute_alignment(rows: list[tuple]) -> list[tuple]:
    """Groups by sets of ends, links by products, counts over all rows."""
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    sides = alignment.load(BYTES, PIECES)
    found = []
    for doc, text in rows:
        groups = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, MODEL.library.encode(text)
            parts_a = [sides.bytes_a[k] for k in a]
            parts_b = [bytes([int(p[3:-1], 16)]) if MODEL.library.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [MODEL.library.id_to_piece(k)]]
            whole = (" " + text).encode()
            if b"".join(parts_a) == whole == b"".join(parts_b):
                ends_a, ends_b = (np.cumsum([len(p) for p in parts]).tolist() for parts in (parts_a, parts_b))
                shared = sorted(set(ends_a) & set(ends_b))
                low = 0
                for high in shared:
                    groups.append(([k for k, e in zip(a, ends_a) if low < e <= high], [k for k, e in zip(b, ends_b) if low < e <= high]))
                    low = high
        found.append((doc, groups))
    counts = Counter(pair for _, groups in found for pair in {(x, y) for p, q in groups for x in p for y in q})
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc, groups in found:
        links = [(x, y) for p, q in groups for x in p for y in q]
        line = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links),
                    sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), sha256(line.encode()).hexdigest() if groups else ""))
    return out


def test_alignment_query(spark, small, texts):
    rows = QUERIES["op11_token_links"](spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(brute_alignment(list(texts.items())))


def test_alignment_edges(spark, edge, none):
    extra = [(20, "a▁b"), (21, "日本語のテキスト 文字 \U0001f600\U0001f600"), (22, "<|endoftext|> x"), (23, "naïve  café\n\n\tx " * 300), (20, "twice"), (24, "x" * 3000 + "é" * 999)]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(d, t) for d, t, _, _ in EDGE] + extra
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, alignment.token_links(docs, BYTES, PIECES).collect()), key=key) == sorted(brute_alignment(rows), key=key)
    assert alignment.token_links(none, BYTES, PIECES).count() == 0


def test_lanes_and_batches_change_nothing(spark, monkeypatch):
    """Long texts in many lanes, every run a batch of its own: counts still cover all documents."""
    sides = alignment.load(BYTES, PIECES)
    draw = random.Random(9)
    words = [f"w{draw.randrange(99)}ord" for _ in range(50)] + ["文字", "é", "  ", "\U0001f600"]
    many = [" ".join(draw.choices(words, k=draw.randrange(2500))) for _ in range(12)]
    whole = alignment.align(sides, many)
    monkeypatch.setattr(alignment, "LANE", 10 ** 9)
    for name, column in alignment.align(sides, many).items():
        assert column.equals(whole[name]), name


# --- 12: Lloyd ------------------------------------------------------------------


def brute_lloyd(rows: list[tuple], k: int = 16, rounds: int = 3) -> list[tuple]:
    kept = [(d, [math.floor(64 * x) for x in v]) for d, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (r[0] is None, sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=rank)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[x for _, x in kept if nearest(x)[1] == j] for j in range(len(centroids))]
        centroids = [[sum(col) // len(xs) for col in zip(*xs)] if xs else c for xs, c in zip(members, centroids)]
    at = [nearest(x) for _, x in kept]
    own = Counter()
    for d, j in at:
        own[j] += d
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, own[j], sum(own.values()), digest[j]) for (i, _), (d, j) in zip(kept, at)]


def test_lloyd_query(spark, small):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{small}/embeddings.parquet'").fetchall()
    assert sorted(map(tuple, QUERIES["op12_sharded_lloyd"](spark, small).collect())) == sorted(brute_lloyd(rows))


@pytest.mark.parametrize("width, chunk", [(16, 7), (10, 3), (64, 2048), (1, 50)])
def test_lloyd_blocks_and_odd_vectors(spark, width, chunk):
    draw = random.Random(5)
    vector = lambda scale=1.0: [draw.gauss(0, scale) for _ in range(64)]
    rows = [(k, vector(1 if k % 3 else 500.0)) for k in range(90)] + [(3, vector()), (3, rows_equal := vector()), (3, rows_equal), (None, vector())]
    rows += [(200, None), (201, []), (202, vector()[:63]), (203, [*vector()[:63], None]), (204, [*vector()[:63], float("nan")]), (205, [*vector()[:63], float("-inf")])]
    rows += [(300 + k, [0.5] * 64) for k in range(40)]  # ties and copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    key = lambda r: (r[0] is None, r)
    got = sorted(map(tuple, lloyd.cluster(df, width=width, chunk=chunk).collect()), key=key)
    assert got == sorted(brute_lloyd(rows), key=key)


def test_lloyd_few_and_no_vectors(spark):
    rows = [(k, [float(k)] * 64) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, lloyd.cluster(df).collect())) == sorted(brute_lloyd(rows))
    none = lloyd.cluster(df.limit(0))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
