"""Language of every word by a linear-chain conditional random field, and of every document by its words.

A word (a run of letters) emits by its prefixes, suffixes, character n-grams, itself (all hashed) and the lexicon of frequent words of
each language. Transitions between the languages of neighbouring words are learned with the emissions, by gradient steps on the
exact likelihood (forward-backward). Training sequences are spliced from spans of labelled texts of different languages, so the
chain sees switches. Prediction runs forward-backward over every word of every text; a document's language has the largest mean
posterior of its words, and that mean is the score.

A word is a Unicode letter and the letters and marks behind it; a run of more than ``LONGEST`` is successive words.

Bounds: of each of the commonest languages at most ``per_language`` labelled texts are fitted on, the first in the order of a hash of
their ids, and of a text longer than ``max_chars`` a span of that length. Chains are cut every ``SPAN`` words; every word is in one.

Defined results: a text that is null or has no letter is ``und`` with score 0.0, and so is everything if no labelled text exists;
null languages are not learned; rows are judged one by one, so repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import grouped

LONGEST = 40  # letters of a word; a longer run is successive words, so that every letter counts
BUCKETS = 1 << 15
SPAN = 128  # words of a chain
KNOWN = 300_000  # words remembered per worker
UNDETERMINED = "und"
_ASCII = re.compile(f"[a-z]{{1,{LONGEST}}}")


@lru_cache(maxsize=1)
def _word() -> re.Pattern:
    """A Unicode letter and the letters and marks behind it; digits, fractions and numerals are no letters."""
    def ranges(*kinds: str) -> str:
        inside = [unicodedata.category(chr(c))[0] in kinds for c in range(sys.maxunicode + 1)]
        cuts = [c for c, (a, b) in enumerate(zip([False, *inside], [*inside, False])) if a != b]
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(cuts[::2], cuts[1::2]))

    return re.compile(f"[{ranges('L')}][{ranges('L', 'M')}]{{0,{LONGEST - 1}}}")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a text."""
    text = (text or "").lower()
    return (_ASCII if text.isascii() else _word()).findall(text)


def _features(w: str) -> list[int]:
    marked = f"^{w}$"
    parts = [f"p{w[:k]}" for k in (1, 2, 3)] + [f"s{w[-k:]}" for k in (1, 2, 3)] + [f"w{w}"]
    parts += [marked[k:k + 2] for k in range(len(marked) - 1)] + [marked[k:k + 3] for k in range(len(marked) - 2)]
    return [crc32(p.encode()) % BUCKETS for p in parts]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + languages, languages); the last rows are the lexicons
    transitions: np.ndarray  # (languages, languages), logarithms
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of lower-cased words, (words, languages)."""
        lists = [_features(w) + ([BUCKETS + self.lexicon[w]] if w in self.lexicon else []) for w in words]
        flat = np.fromiter((f for fs in lists for f in fs), np.int64)
        starts = np.cumsum([0, *map(len, lists[:-1])])
        return np.add.reduceat(self.weights[flat], starts, axis=0) if lists else np.zeros((0, len(self.languages)), np.float32)


def forward_backward(scores: np.ndarray, real: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of padded chains. ``scores`` (steps, chains, languages), ``real`` (steps, chains) marks words; padding comes last.

    Returns posteriors, and for learning the scaled forward and backward vectors and word potentials.
    """
    steps = len(scores)
    move = np.exp(transitions)
    pot = np.exp(scores - scores.max(axis=2, keepdims=True))
    alpha, beta = np.empty_like(pot), np.empty_like(pot)
    now = pot[0] / pot[0].sum(axis=1, keepdims=True)
    alpha[0] = now
    for t in range(1, steps):
        now = (now @ move) * pot[t]
        now /= now.sum(axis=1, keepdims=True)
        alpha[t] = now
    now = np.ones_like(pot[0])
    beta[-1] = now
    for t in range(steps - 2, -1, -1):
        now = (pot[t + 1] * now) @ move.T
        now /= now.sum(axis=1, keepdims=True)
        now = np.where(real[t + 1][:, None], now, 1.0)
        beta[t] = now
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    return post, alpha, beta, pot


# --- learning -------------------------------------------------------------------


def _sequences(texts: dict[str, list[list[str]]], rng: np.random.Generator, mean_span: int = 24) -> tuple[list[str], np.ndarray]:
    """All words in chains of spans that switch between texts at random, and the language of each."""
    queues = [(k, words) for k, name in enumerate(sorted(texts)) for words in texts[name] if words]
    spans = []
    for k, words in queues:
        at = 0
        while at < len(words):
            n = int(rng.geometric(1 / mean_span))
            spans.append((k, words[at:at + n]))
            at += n
    order = rng.permutation(len(spans))
    words = [w for i in order for w in spans[i][1]]
    labels = np.array([spans[i][0] for i in order for _ in spans[i][1]], np.int64)
    return words, labels


def fit(texts: dict[str, list[list[str]]], epochs: int = 3, batch: int = 64, rate: float = 0.05, seed: int = 7) -> Model:
    """Texts by language, each a list of lower-cased words."""
    languages = sorted(texts)
    k = len(languages)
    counts = {name: Counter(w for ws in texts[name] for w in ws) for name in languages}
    total = sum(counts.values(), Counter())
    lexicon = {w: max(range(k), key=lambda j: counts[languages[j]][w]) for w, n in total.items() if n >= 3}
    lexicon = {w: j for w, j in lexicon.items() if counts[languages[j]][w] >= 0.8 * total[w]}
    model = Model(languages, np.zeros((BUCKETS + k, k), np.float32), np.zeros((k, k), np.float32), lexicon)
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    words, labels = _sequences(texts, rng)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    lists = [_features(w) + ([BUCKETS + lexicon[w]] if w in lexicon else []) for w in vocabulary]
    bounds = np.cumsum([0, *map(len, lists)])
    flat = np.fromiter((f for fs in lists for f in fs), np.int64)
    ids = np.fromiter((vocabulary[w] for w in words), np.int64, len(words))
    chains = -(-len(ids) // SPAN)
    pad = chains * SPAN - len(ids)
    ids = np.append(ids, np.zeros(pad, np.int64)).reshape(chains, SPAN)
    gold = np.append(labels, np.zeros(pad, np.int64)).reshape(chains, SPAN)
    mask = np.append(np.ones(len(labels), bool), np.zeros(pad, bool)).reshape(chains, SPAN)
    square_w, square_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    eye = np.eye(k, dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(chains)
        for at in range(0, chains, batch):
            pick = order[at:at + batch]
            used, inverse = np.unique(ids[pick], return_inverse=True)
            span = np.diff(bounds)[used]
            feats = flat[np.repeat(bounds[used] - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())]
            scores = np.add.reduceat(model.weights[feats], np.r_[0, np.cumsum(span)[:-1]], axis=0)
            inverse = inverse.reshape(len(pick), SPAN).T
            real, truth = mask[pick].T, gold[pick].T
            post, alpha, beta, pot = forward_backward(scores[inverse], real, model.transitions)
            wrong = (eye[truth] - post) * real[:, :, None]
            by_word = np.zeros((len(used), k), np.float32)
            np.add.at(by_word, inverse.ravel(), wrong.reshape(-1, k))
            step_w = np.zeros_like(model.weights)
            np.add.at(step_w, feats, np.repeat(by_word, span, axis=0))
            pair = alpha[:-1, :, :, None] * np.exp(model.transitions) * (pot[1:] * beta[1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            seen = eye[truth[:-1]][:, :, :, None] * eye[truth[1:]][:, :, None, :]
            step_t = ((seen - pair) * real[1:, :, None, None]).sum(axis=(0, 1))
            for value, step, square in ((model.weights, step_w, square_w), (model.transitions, step_t, square_t)):
                square += step * step  # steps shrink with what a weight has moved so far
                value += rate * step / np.sqrt(square)
    return model


def split_of(id_col: Column) -> Column:
    """Remainder that keeps every third id out of learning; null for a null id."""
    return F.crc32(id_col.cast("string")) % 3


def sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, max_chars: int, languages: int = 64,
) -> dict[str, list[list[str]]]:
    """Words of the bounded training sample, by language: of each of the commonest ``languages`` the first rows by hash, each task keeping
    no more than it may need. Of a longer text a span of ``max_chars`` is taken, at a place given by its hash."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (split_of(F.col("id")) != 1) & F.col("text").isNotNull())
    names = [r["lang"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    order = Window.partitionBy("lang").orderBy("h", "id", "digest")
    spare = F.greatest(F.length("text") - max_chars, F.lit(0))
    span = F.substring("text", (1 + F.pmod(F.col("h"), spare + 1)).cast("int"), F.lit(max_chars))
    rows = usable.where(F.col("lang").isin(names)).select("id", "lang", "text", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("digest"))
    rows = rows.select("id", "lang", "h", "digest", span.alias("text")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    lists: dict[str, list[list[str]]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["place"])):
        lists.setdefault(r["lang"], []).append(words_of(r["text"]))
    return {name: found for name, found in lists.items() if any(found)}


# --- prediction -----------------------------------------------------------------


class Labeller:
    """Posteriors of whole texts. Emissions of words are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.known.clear()
            self.scores = self.scores[:0]
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.emissions(new).astype(np.float32)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of every word (in order) and the number of words of every text."""
        lists = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        n = int(counts.sum())
        if not n:
            return np.zeros((0, len(self.model.languages))), counts
        ids = self._ids([w for ws in lists for w in ws])
        # chains of at most SPAN words of one text, as columns of a padded array

        place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        step = place % SPAN
        chain = np.cumsum(step == 0) - 1
        longest = int(step.max()) + 1
        scores = np.zeros((longest, chain[-1] + 1, len(self.model.languages)), np.float32)
        real = np.zeros(scores.shape[:2], bool)
        scores[step, chain], real[step, chain] = self.scores[ids], True

        return forward_backward(scores, real, self.model.transitions)[0][step, chain], counts

    def documents(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        posterior, counts = self.words(texts)
        names, best = [UNDETERMINED] * len(counts), np.zeros(len(counts))
        some = np.flatnonzero(counts)
        if len(some) and len(self.model.languages):
            starts = (np.cumsum(counts) - counts)[some]
            mean = np.add.reduceat(posterior, starts, axis=0, dtype=np.float64) / counts[some, None]
            for i, k in zip(some, mean.argmax(axis=1)):
                names[i] = self.model.languages[k]
            best[some] = np.clip(mean.max(axis=1), 0.0, 1.0)
        return names, best


    def clarity(self, texts: list[str | None]) -> np.ndarray:
        """How sure the language of a text's words is, in the mean; 0 without a letter, 1 without a learned language."""
        if not self.model.languages:
            return np.array([float(bool(words_of(t))) for t in texts])
        posterior, counts = self.words(texts)
        sure = np.r_[0, np.cumsum(posterior.max(axis=1, initial=0.0), dtype=np.float64)]
        ends = np.cumsum(counts)
        return (sure[ends] - sure[ends - counts]) / np.maximum(counts, 1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200, max_chars: int = 20_000) -> Model:
    """The model of a table's labelled texts; held-out ids are not learned."""
    return fit(sample(docs, id_col, text_col, lang_col, per_language, max_chars))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``; only the text is looked at."""
    rows = docs.select(*[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS and the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        names = [f"k{k}" for k in range(len(keep))]
        for batch in batches:
            at = 0
            for texts in grouped(t.as_py() for t in batch.column(len(keep))):
                found, score = labeller.documents(texts) if labeller.model.languages else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
                own = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])
                at += len(texts)

    kinds = ", ".join(f"k{k} {rows.schema[f'k{k}'].dataType.simpleString()}" for k in range(len(keep)))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double").toDF(*keep, "lang_pred", "score")


def keep_clear(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.4) -> DataFrame:
    """The documents with a letter whose words have a clear language each, ``min_score`` in the mean; all columns. A text may switch between
    languages. Without a learned language every text with a letter stays."""
    at_text, names = docs.columns.index(text_col), docs.columns
    rows = docs.toDF(*[f"k{k}" for k in range(len(names))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            at = 0
            for texts in grouped(t.as_py() for t in batch.column(at_text)):
                yield batch.slice(at, len(texts)).filter(pa.array(labeller.clarity(texts) >= min_score, pa.bool_()))
                at += len(texts)

    return rows.mapInArrow(run, rows.schema).toDF(*names)


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of words of one language: ``id_col``, ``first`` and ``words`` (count), ``lang``, ``score``. Shows where a text switches."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            at = 0
            for texts in grouped(t.as_py() for t in batch.column(1)):
                posterior, counts = labeller.words(texts)
                cut = np.repeat(np.arange(len(counts)), counts)
                best = posterior.argmax(axis=1) if posterior.size else np.zeros(0, np.int64)
                starts = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (cut[1:] != cut[:-1])]) if len(best) else np.zeros(0, np.int64)
                size = np.diff(np.r_[starts, len(best)])
                score = np.add.reduceat(posterior.max(axis=1), starts) / size if len(starts) else np.zeros(0)
                doc = cut[starts]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)).take(pa.array(doc)), pa.array(starts - (np.cumsum(counts) - counts)[doc]),
                    pa.array(size, pa.int64()), pa.array([labeller.model.languages[k] for k in best[starts]], pa.string()),
                    pa.array(score, pa.float64())], names=["id", "first", "words", "lang", "score"])
                at += len(texts)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, first long, words long, lang string, score double").withColumnRenamed("id", id_col)
