"""Toxicity categories by a classifier chain.

Categories are predicted one after another by logistic models; each sees the terms of the text and the probabilities of the categories
before it. While learning, those earlier probabilities are out-of-fold predictions (every row is predicted by models that did not see
it), as the chain will meet predictions, not truths, later. The last link is toxicity itself.

Terms are words and word beginnings of four and six letters, for languages that inflect and compound. The most telling ones by
chi-square on the labelled sample are used, each with its count and its share of the words, so that a long text is not taken for
toxic because some beginning occurs in it now and then. Labels: ``toxic`` is given. Categories are learned: the terms that toxic
texts of the sample have clearly more often than others are grouped by the texts they occur in together, and a category holds for
a toxic text with a term of its group, ``unlisted`` for a toxic text with none. Bounds: at most ``max_rows`` labelled texts, the
first in the order of a hash of their ids, and ``n_terms`` terms.

Defined results: null and empty texts have no words; rows are judged one by one, alike if repeated; labels that are null are not
learned; ids labelled twice take the larger label; of the texts of one id the one with the smallest hash is learned from; without labels of both kinds every probability is null and nothing is toxic;
other columns are not read; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import saved

WORD = re.compile(r"[^\W\d_]+")
GROUPS = 3
NAMES = [*[f"category_{k + 1}" for k in range(GROUPS)], "unlisted", "toxicity"]
LIFT = 3.0  # a telling term is this many times as frequent in toxic texts as in others
FOLDS = 3


@dataclass
class Chain:
    terms: list[str]
    links: list[tuple[str, np.ndarray]]  # category and weights: features, earlier categories, bias
    groups: list[list[str]] = field(default_factory=list)  # terms of the learned categories


def terms(text: str | None) -> tuple[Counter, int]:
    """Counts of words and, marked by a star, of beginnings of longer words; number of words."""
    words = Counter(WORD.findall((text or "").lower()))
    out = Counter(words)
    for word, n in words.items():
        for size in (4, 6):
            if len(word) > size:
                out[word[:size] + "*"] += n
    return out, words.total()


def features(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Counts (rows, terms) and lengths as inputs of the models."""
    n = np.maximum(n_words, 1)[:, None]
    return np.hstack([np.log1p(counts), 10 * np.sqrt(counts / n), np.log1p(n_words)[:, None]])


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, turns: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, penalty), 1e-6]
    for _ in range(turns):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(terms: list[str], x: np.ndarray, labels: list[tuple[str, np.ndarray]], folds: np.ndarray) -> Chain:
    """The chain over ``labels`` in their order; ``folds`` numbers the fold of every row."""
    links, seen = [], x.astype(np.float64)
    for name, y in labels:
        links.append((name, _fit(seen, y)))
        out = np.zeros(len(y))
        for fold in np.unique(folds):
            inside = folds == fold
            w = _fit(seen[~inside], y[~inside]) if (~inside).any() else links[-1][1]
            out[inside] = _sigmoid(seen[inside] @ w[:-1] + w[-1])
        seen = np.hstack([seen, out[:, None]])
    return Chain(terms, links)


def grouped_terms(has: np.ndarray, toxic: np.ndarray, groups: int = GROUPS, turns: int = 20) -> np.ndarray:
    """Group number of every term (column of ``has``), -1 for one that is not telling; by spherical k-means over the toxic texts.

    Centres start at the term of most toxic texts and then at terms least alike to those taken, so the result has no chance in it.
    """
    out = np.full(has.shape[1], -1)
    inside, outside = has[toxic > 0], has[toxic == 0]
    rate, other = inside.mean(axis=0), outside.mean(axis=0)
    telling = np.flatnonzero((rate > 0) & (rate >= LIFT * other))
    if not len(telling):
        return out
    x = inside[:, telling].T.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    taken = [int(np.argmax(rate[telling]))]
    while len(taken) < min(groups, len(telling)):
        taken.append(int(np.argmin((x @ x[taken].T).max(axis=1))))
    centres = x[taken]
    for _ in range(turns):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[near == k].sum(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        fresh = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        if np.allclose(fresh, centres):
            break
        centres = fresh
    out[telling] = (x @ centres.T).argmax(axis=1)
    return out


def apply(chain: Chain, x: np.ndarray) -> np.ndarray:
    """Probabilities (rows, links): every link reads those before it."""
    seen = x.astype(np.float64)
    for _, w in chain.links:
        seen = np.hstack([seen, _sigmoid(seen @ w[:-1] + w[-1])[:, None]])
    return seen[:, x.shape[1]:]


def _bags(texts: DataFrame) -> DataFrame:
    """Terms of every sampled text, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, toxic, text in zip(*[c.to_pylist() for c in batch.columns]):
                counts, n = terms(text)
                counts = counts or {None: 0}  # a text without words is learned from as well
                k = len(counts)
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array([h] * k, pa.int64()), "toxic": pa.array([toxic] * k, pa.int32()), "n_words": pa.array([n] * k, pa.int64()),
                    "term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return texts.mapInArrow(run, "h long, toxic int, n_words long, term string, n long")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_rows: int = 5000, n_terms: int = 128) -> Chain | None:
    """A chain fitted on a bounded sample; None without labels of both kinds."""
    known = labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(toxic_col).cast("int").alias("toxic"))
    chosen = saved(known.select("id", "toxic", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(max_rows), "toxicity-rows")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    copies = texts.join(F.broadcast(chosen), "id")  # a row per label and copy of its id
    one = copies.groupBy("h", "toxic", "id").agg(F.min(F.struct(F.xxhash64("text").alias("of"), "text")).alias("first"))
    bags = saved(_bags(one.select("h", "toxic", "first.text")), "toxicity-sample")  # at most max_rows texts
    rows = bags.select("h", "toxic", "n_words").distinct()
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < n:
        return None
    counts = bags.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("a"))
    off = (F.col("a") * n - F.col("n") * bad).cast("double")
    chi = off * off / (F.col("n") * F.greatest(n - F.col("n"), F.lit(1)))
    picked = counts.where("n >= 5").select("term", chi.alias("chi")).orderBy(F.desc("chi"), "term").limit(n_terms)
    names = sorted(r["term"] for r in picked.collect())
    rows = rows.orderBy("h", "n_words").collect()
    place, index = {t: k for k, t in enumerate(names)}, {r["h"]: i for i, r in enumerate(rows)}
    table = np.zeros((len(rows), len(names)))
    for r in bags.where(F.col("term").isin(names)).collect():  # rows x terms at most
        table[index[r["h"]], place[r["term"]]] = r["n"]
    toxic = np.array([r["toxic"] for r in rows], np.float64)
    group = grouped_terms(table > 0, toxic)
    holds = np.array([(table[:, group == k] > 0).any(axis=1) for k in range(GROUPS)])
    labels_of = [(NAMES[k], toxic * holds[k]) for k in range(GROUPS)]
    labels_of.append(("unlisted", toxic * ~holds.any(axis=0)))
    folds = np.array([r["h"] % FOLDS for r in rows])
    x = features(table, np.array([r["n_words"] for r in rows], np.float64))
    chain = fit(names, x, [*labels_of, ("toxicity", toxic)], folds)
    chain.groups = [[t for t, g in zip(names, group) if g == k] for k in range(GROUPS)]
    return chain


def predict(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """``id_col``, a probability per category, ``toxicity``, ``is_toxic``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if chain is None:
        return rows.select(F.col("id").alias(id_col), *[F.lit(None).cast("double").alias(n) for n in NAMES], F.lit(False).alias("is_toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(shared.value.terms)}
        for batch in batches:
            table, n_words = np.zeros((batch.num_rows, len(place))), np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                counts, n_words[i] = terms(text.as_py())
                for t in place.keys() & counts.keys():
                    table[i, place[t]] = counts[t]
            p = apply(shared.value, features(table, n_words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= cutoff)], names=["id", *NAMES, "is_toxic"])

    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{n} double" for n in NAMES], "is_toxic boolean"])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
