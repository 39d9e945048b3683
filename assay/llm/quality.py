"""Quality rules whose cutoffs follow the data of each language and source.

Every text is measured once. Each measure is summarised per (language, source) by a log-bucketed quantile sketch: counts per
bucket, with a relative error of ``accuracy``. Such sketches merge by adding counts, so the sketch of a language is the sum of
its sources, and a hot source costs one row per bucket and task. A source's quartiles are averaged with its language's, weighted by
its number of texts, so a small source nearly takes those of its language and nothing jumps as it grows. Cutoffs lie a reach
outside the quartiles, held within a multiple of the language's own, so a source that is mostly junk cannot raise them at
will and no number for one family of languages enters. The last step joins the cutoffs back and filters. Everything is DataFrame
functions.

Defined results: a null text counts as empty and fails the base rule (fewer than ten words); null language or source form
their own group; repeated rows are judged one by one, alike; an empty table gives an empty result; other columns, whatever
their names, are neither read nor changed; texts of any length are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bind, saved, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Measure:
    """One adaptive rule: the upper cutoff is the third quartile plus ``reach`` times the quartile distance, and at least ``slack``
    (of the median, if ``relative``) above the median. Where there is a lower cutoff (``both``), it lies as far below.

    ``short`` loosens a cutoff by itself over the number of words, as means of few words scatter.
    """

    name: str
    reach: float
    slack: float
    relative: bool = False
    both: bool = False
    short: float = 0.0


MEASURES = (
    Measure("mean_word", 6.0, 0.4, relative=True, both=True, short=40.0),
    Measure("symbol_share", 3.0, 0.1),
    Measure("duplicate_lines", 3.0, 0.4),
    Measure("upper_share", 6.0, 0.2),
    Measure("stutter_share", 6.0, 0.15),
)
ACCURACY = 0.01
WEIGHT = 200  # texts that the quartiles of the wider group count for
WIDER = 2.0  # a source may be this many times as far from its language's quartiles as the language's own cutoffs are


def _repeat_words(words: Column) -> Column:
    """Words inside a window of five words that occurs again in the text."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        gaps = _neighbours(starts, lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

    def starts_of(pairs: Column) -> Column:  # sorted by window: equal windows are neighbours
        near = _neighbours(pairs, lambda a, b: F.when(a.h == b.h, F.array(a.p, b.p)).otherwise(F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(near)))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bind(bind(pairs, starts_of), covered)).otherwise(F.lit(0))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(bind(windows, count))


def _neighbours(array: Column, test) -> Column:
    """``test`` of every element and the next one."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(2), n), test)


def measures(text: Column) -> Column:
    """A struct of counts of the whole text. Bound once, so that reading its fields does not repeat the work."""

    def lines_of(text: Column) -> Column:
        return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(_neighbours(words, lambda a, b: a == b), lambda same: same)).cast("long").alias("n_stutter"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    return bind(F.coalesce(text, F.lit("")), lambda t: F.struct(
        bind(words_of(t), of_words).alias("w"), bind(lines_of(t), of_lines).alias("l"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper")))


def measured(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the counts and the base rule; ``rows`` must not have columns of these names."""
    own = list(rows.columns)
    wide = rows.select(*own, measures(text).alias("_m"))
    counts = {"n_words": "w", "word_chars": "w", "n_symbols": "", "n_dup_lines": "l", "n_repeat_words": "w", "n_lines": "l", "n_upper": "", "n_stutter": "w"}
    out = wide.select(*own, *[F.col(f"_m.{part + '.' if part else ''}{name}").alias(name) for name, part in counts.items()])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _values() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "mean_word": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "n_words"),
        "duplicate_lines": per("n_dup_lines", "n_lines"),
        "upper_share": per("n_upper", "word_chars"),
        "stutter_share": per("n_stutter", "n_words"),
    }


def sketches(counts: DataFrame, accuracy: float = ACCURACY) -> DataFrame:
    """Mergeable quantile sketches of every measure: rows per (lang, source, measure, bucket), of texts that pass the base rule.

    Bucket b holds values in (g^(b-1), g^b] with g = (1 + accuracy) / (1 - accuracy); zero has the lowest bucket.
    """
    log_g = F.lit((1 + accuracy) / (1 - accuracy))
    values = F.array(*[F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in _values().items()])
    long = counts.where(~F.col("base_failed")).select("lang", "source", F.inline(values))
    bucket = F.when(F.col("value") > 0, F.ceil(F.log(F.col("value")) / F.log(log_g)).cast("int")).otherwise(F.lit(-(2**31) + 1))
    return long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str], accuracy: float) -> DataFrame:
    """Quartiles per group from merged sketches. A window holds the buckets of one group, a bounded number."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.select(
        *keys, "measure", "bucket", F.sum("n").over(group).alias("total"),
        F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    g = (1 + accuracy) / (1 - accuracy)
    value = F.when(F.col("bucket") > -(2**31) + 1, 2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1)).otherwise(F.lit(0.0))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("total") - 1)), value))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def _blended(own: Column, wide: Column, weight: float) -> Column:
    """Quartiles of a group and ``weight`` texts of the wider one: nearly the wider ones for few texts, nearly its own for many."""
    mix = lambda q: ((own["total"] * own[q] + F.lit(float(weight)) * wide[q]) / (own["total"] + F.lit(float(weight)))).alias(q)
    return F.struct(mix("q1"), mix("q2"), mix("q3"))


def _upper(m: Measure, q: Column, times: float = 1.0) -> Column:
    slack = F.lit(times * m.slack) * (q["q2"] if m.relative else F.lit(1.0))
    return F.greatest(q["q2"] + slack, q["q3"] + F.lit(times * m.reach) * (q["q3"] - q["q1"]))


def _lower(m: Measure, q: Column, times: float = 1.0) -> Column:
    slack = F.lit(times * m.slack) * (q["q2"] if m.relative else F.lit(1.0))
    return F.least(q["q2"] - slack, q["q1"] - F.lit(times * m.reach) * (q["q3"] - q["q1"]))


def cutoffs(sketch: DataFrame, accuracy: float = ACCURACY, weight: float = WEIGHT) -> DataFrame:
    """One row per (lang, source) with its cutoffs, from quartiles blended with those of the language, and these with all texts'.

    The blend moves with the number of texts, so a text more never makes a cutoff jump. A source's cutoffs are held within
    ``WIDER`` times the reach and slack around its language's quartiles.
    """
    parts = lambda: F.struct("total", "q1", "q2", "q3")
    own = _quartiles(sketch, ["lang", "source"], accuracy).select("lang", "source", "measure", parts().alias("o"))
    lang = _quartiles(sketch, ["lang"], accuracy).select(F.col("lang").alias("of_lang"), F.col("measure").alias("of_measure"), parts().alias("l"))
    every = _quartiles(sketch, [], accuracy).select(F.col("measure").alias("all_measure"), parts().alias("a"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("measure") == F.col("of_measure"))) \
        .join(F.broadcast(every), F.col("measure") == F.col("all_measure"))  # one row per measure
    wide = joined.withColumn("w", _blended(F.col("l"), F.col("a"), weight))
    q = wide.select("lang", "source", "measure", "w", _blended(F.col("o"), F.col("w"), weight).alias("q"))
    exprs = []
    for m in MEASURES:
        mine = F.col("measure") == m.name
        exprs.append(F.max(F.when(mine, F.least(_upper(m, F.col("q")), _upper(m, F.col("w"), WIDER)))).alias(f"max_{m.name}"))
        if m.both:
            exprs.append(F.max(F.when(mine, F.greatest(_lower(m, F.col("q")), _lower(m, F.col("w"), WIDER)))).alias(f"min_{m.name}"))
    return q.groupBy("lang", "source").agg(*exprs)


def judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """``counts`` with ``kept``. The cutoffs have one row per group; a group without any has only base failures.

    Both sides are plain columns of written tables, so Spark broadcasts the cutoffs where they are small and splits a hot
    source where they are not.
    """
    right = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in limits.columns if c[:4] in ("max_", "min_")])
    both = counts.join(right, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    values = _values()
    loose = {m.name: F.lit(m.short) / F.greatest(F.col("n_words"), F.lit(1)) for m in MEASURES}
    good = [values[m.name] <= F.col(f"max_{m.name}") + loose[m.name] for m in MEASURES]
    good += [values[m.name] >= F.col(f"min_{m.name}") - loose[m.name] for m in MEASURES if m.both]
    kept = F.coalesce(~F.col("base_failed") & reduce(lambda a, b: a & b, good), F.lit(False))
    return both.select(*counts.columns, kept.alias("kept"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, counts, base_failed, kept."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("_text"))
    counts = saved(measured(rows, F.col("_text")).drop("_text"), "quality-counts")
    out = judged(counts, saved(cutoffs(sketches(counts)), "quality-cutoffs"))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, with all their columns; texts are measured once and travel with the written counts."""
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.`{lang_col}`").alias("lang"), F.col(f"row.`{source_col}`").alias("source"))
    counts = saved(measured(rows, F.col(f"row.`{text_col}`")), "quality-rows")
    out = judged(counts, saved(cutoffs(sketches(counts)), "quality-cutoffs"))
    return out.where("kept").select("row.*")
