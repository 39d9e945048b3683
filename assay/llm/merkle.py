"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Leaves are sentences (cut further where they run long, at words picked by their own hash), their parents paragraphs (lines), their
parents sections (ended by an empty line or a paragraph picked by its own hash), and the root covers all. Every node is the hash of
its children, so equal roots mean equal texts. All cuts depend on nearby text only: an edit changes the leaves it touches and the
branches above them. A fingerprint is the root and the leaves' short hashes in tree order, ``root:leaf leaf,leaf;leaf``: a comma ends
a paragraph, a semicolon a section. Two fingerprints are compared from the top; only branches that differ are opened, which both
measures likeness and locates edits.

Defined results: null text is empty; an empty text has one empty paragraph and no leaf; two texts without leaves are alike (1.0), one
against another 0.0; other columns are not read; repeated rows have equal fingerprints; texts are taken whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")
LONG = 80  # characters; longer sentences are cut at words whose hash is 0 modulo CUT
CUT = 4
SECTION = 8  # a paragraph ends its section if its hash is 0 modulo this


def _leaves(paragraph: str) -> list[str]:
    out = []
    for sentence in SENTENCE.findall(paragraph):
        if len(sentence) <= LONG:
            out.append(sentence)
            continue
        run: list[str] = []
        for word in sentence.split(" "):
            run.append(word)
            if crc32(word.encode()) % CUT == 0:
                out.append(" ".join(run))
                run = []
        if run:
            out.append(" ".join(run))
    return out


def _node(children: list[bytes]) -> bytes:
    return blake2b(b"".join(children), digest_size=16).digest()


def tree(text: str | None) -> list[list[tuple[bytes, list[bytes]]]]:
    """Sections of paragraphs, each with its hash and the hashes of its leaves."""
    sections: list[list[tuple[bytes, list[bytes]]]] = [[]]
    for paragraph in (text or "").split("\n"):
        leaves = [blake2b(leaf.encode(), digest_size=16).digest() for leaf in _leaves(paragraph)]
        node = _node(leaves)
        sections[-1].append((node, leaves))
        if not leaves or node[0] % SECTION == 0:
            sections.append([])
    if not sections[-1]:
        sections.pop()
    return sections


def fingerprint(text: str | None) -> str:
    sections = tree(text)
    root = _node([_node([node for node, _ in section]) for section in sections])
    body = ";".join(",".join(" ".join(leaf[:4].hex() for leaf in leaves) for _, leaves in section) for section in sections)
    return f"{root.hex()}:{body}"


def _open(branches: list[str], mark: str) -> list[str]:
    return [child for branch in branches for child in branch.split(mark)]


def likeness(a: str, b: str) -> float:
    """Share of leaves in common (Dice), found from the top: equal branches count whole, others are opened."""
    if a[:32] == b[:32]:
        return 1.0
    (left, right), same = ([x[33:]] for x in (a, b)), 0
    total = sum(len(x[33:].replace(";", " ").replace(",", " ").split()) for x in (a, b))
    for mark in ";, ":
        ours, theirs = Counter(_open(left, mark)), Counter(_open(right, mark))
        common = ours & theirs
        same += sum(n * len(branch.replace(",", " ").split()) for branch, n in common.items())
        left, right = list((ours - common).elements()), list((theirs - common).elements())
    return 2 * same / total if total else 1.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Paragraphs of ``b`` (section, paragraph within it) that ``a`` does not have: where an edit is."""
    if a[:32] == b[:32]:
        return []
    known_sections, known = Counter(a[33:].split(";")), Counter(_open(a[33:].split(";"), ","))
    out = []
    for s, section in enumerate(b[33:].split(";")):
        whole = known_sections[section] > 0
        known_sections[section] -= whole
        for p, paragraph in enumerate(section.split(",")):
            if known[paragraph] > 0:
                known[paragraph] -= 1
            elif not whole:
                out.append((s, p))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_chars``, ``fingerprint`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(len(t := x.as_py()), fingerprint(t)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in pairs], pa.int64()), pa.array([f for _, f in pairs], pa.string())],
                names=["id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _hash(text: str) -> Column:
    """52 bits, as quantile sketches hold numbers as doubles and a cut must be the value of a row."""
    return F.shiftright(F.xxhash64(text), 12)


def _cuts(rows: DataFrame, parts: int) -> list[tuple]:
    """(id, hash) of the very first row and of the rows that begin the further ranges, descending; at most about two per range.

    Ids at equal shares of the rows begin ranges; one that several shares fall on is cut at as many shares of its texts' hashes.
    """
    shares = [k / parts for k in range(1, parts)] or [0.5]
    head = rows.agg(F.percentile_approx("id", shares, 100 * parts).alias("cuts"), F.max("id").alias("top"), F.count("id").alias("known"), F.count(F.lit(1)).alias("n")).first()
    if not head["n"]:
        return []
    wanted = Counter(head["cuts"] or []) if parts > 1 else Counter()
    wanted[None] = round(parts * (head["n"] - head["known"]) / head["n"])
    some = list({*wanted, head["top"]} - {None})
    h = _hash("text")
    found = rows.where(F.col("id").isNull() | F.col("id").isin(some)).groupBy("id").agg(F.max(h).alias("first"), F.percentile_approx(h, shares, 100 * parts).alias("cuts")).collect()
    begins = set()
    for r in found:  # a row per wanted id
        begins.add((r["id"], r["first"]))
        times = wanted[r["id"]]
        begins |= {(r["id"], r["cuts"][(k * len(r["cuts"])) // times]) for k in range(1, times)}
    return sorted(begins, key=lambda c: (c[0] is not None, c[0] if c[0] is not None else 0, c[1]), reverse=True)


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document by descending ``id_col`` (a number).

    Texts move once: rows are cut into ranges at some of their own (id, hash of the text), so the first document of a range is known
    beforehand and a copy of it goes to the range before, where it closes the sequence; the very first closes the last. An id, or null
    ids, with more than a range's share of the rows is cut by its texts' hashes; only equal texts of one id stay together. Null ids
    come last; equal ids are ordered by the hash of the text, descending.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    cuts = _cuts(rows, parts)
    key = F.struct("id", _hash("text").alias("h"))
    literal = lambda c: F.struct(F.lit(c[0]).cast(kind).alias("id"), F.lit(c[1]).cast("long").alias("h"))
    bounds = F.array(*[literal(c) for c in cuts[1:]]) if len(cuts) > 1 else F.array().cast(f"array<struct<id:{kind.simpleString()},h:bigint>>")
    keyed = rows.select("id", "text", key.alias("key"))
    last = max(len(cuts) - 1, 0)
    part = F.size(F.filter(bounds, lambda c: F.col("key") <= c))
    copies = F.array_compact(F.array(
        F.struct(part.alias("part"), F.lit(False).alias("copy")),
        F.when(F.array_contains(bounds, F.col("key")), F.struct((part - 1).alias("part"), F.lit(True).alias("copy"))),
        F.when(F.col("key") == (literal(cuts[0]) if cuts else F.lit(None)), F.struct(F.lit(last).alias("part"), F.lit(True).alias("copy"))),
    ))
    dealt = keyed.select("key", "text", F.inline(copies)).repartitionById(last + 1, F.col("part"))
    ordered = dealt.sortWithinPartitions("copy", F.col("key").desc(), "text").select("key.id", "text", "copy")

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, closed = None, False
        for batch in batches:
            out = []
            for key, text, copy in zip(*[c.to_pylist() for c in batch.columns]):
                if closed:
                    break
                own = fingerprint(text)
                if before is not None:
                    id_, was, mark = before
                    other = edited(was, text)
                    new = fingerprint(other)
                    out.append((id_, len(was), sha256(other.encode()).hexdigest(), mark, new, likeness(mark, new), likeness(mark, own)))
                before, closed = (key, text, own), copy
            columns = [pa.array([row[k] for row in out], kind or batch.schema.field(0).type) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)
