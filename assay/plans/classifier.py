"""A trainable table classifier: roles or table kinds from labelled examples."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.columns import col, kinds, missing_as_null
from ..operators.repair import class_weights
from .analyze import settle


def train_classifier(
    examples: DataFrame, label: str, trees: int = 200, depth: int = 8, seed: int = 42, minimum: int = 20
) -> PipelineModel | None:
    """A random forest over one-hot text columns (with a level for nulls) and numeric columns.

    Classes are weighted to balance. Needs ``minimum`` labelled rows, else None.
    """
    rows = missing_as_null(examples).filter(col(label).isNotNull())
    if rows.limit(minimum).count() < minimum:
        return None
    rows, inputs = _prepare(class_weights(rows, label), label)
    stages = [StringIndexer(inputCol="__label", outputCol="__y")]
    texts = [source for source, kind in inputs if kind == "text"]
    if texts:  # one pass over the rows for all of them
        places, marks = ([f"{source}_{end}" for source in texts] for end in "iv")
        stages.append(StringIndexer(inputCols=texts, outputCols=places, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=places, outputCols=marks, dropLast=False))
    vectors = [f"{source}_v" if kind == "text" else source for source, kind in inputs]
    stages.append(VectorAssembler(inputCols=vectors, outputCol="__features", handleInvalid="keep"))
    stages.append(
        RandomForestClassifier(
            labelCol="__y", featuresCol="__features", weightCol="weight",
            numTrees=trees, maxDepth=depth, seed=seed,
        )
    )
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, table: DataFrame, label: str) -> DataFrame:
    """Adds ``predicted``."""
    names = model.stages[0].labels
    rows, _ = _prepare(missing_as_null(table), label, with_label=label in table.columns)
    if "__label" not in rows.columns:
        rows = rows.withColumn("__label", F.lit(names[0]))
    out = PipelineModel(stages=model.stages[1:]).transform(rows)
    labels = F.array(*[F.lit(n) for n in names])
    return out.withColumn("predicted", F.get(labels, F.col("prediction").cast("int"))).select(
        *table.columns, "predicted"
    )


def column_descriptors(profiles: DataFrame) -> DataFrame:
    """What a column looks like, from profiles (one row per run and column): measures, type, shape of its name. No rule's verdict is among them."""
    name = F.lower("column")
    parts = F.split(name, "_")
    return profiles.select(
        "run_id", "column", "kind", "null_rate", "cardinality_ratio", F.log10(F.coalesce("n_unique", F.lit(0)) + 1.0).alias("distinct_digits"),
        F.log10(F.col("n_rows") + 1.0).alias("row_digits"), "top_share", "avg_len", "numeric_parse_rate", "clean_numeric_parse_rate", "datetime_parse_rate",
        F.length(name).cast("double").alias("name_length"), F.size(parts).cast("double").alias("name_parts"),
        F.element_at(parts, -1).alias("last_part"), F.expr("right(lower(`column`), 3)").alias("ending"))


def out_of_fold(examples: DataFrame, label: str, group: str, folds: int = 3, **forest) -> DataFrame:
    """``examples`` with ``fold`` and ``predicted``: every row judged by a forest that saw no row of its group.

    Groups are dealt to folds by rank of their hash; ``examples`` is a bounded table, as of one row per column. Groups are dealt
    once: all passes of all forests look up the same list.
    """
    order = Window.orderBy(F.xxhash64("__group"))
    dealt = settle(examples.select(col(group).alias("__group")).distinct().withColumn("fold", (F.row_number().over(order) - 1) % folds))
    rows = examples.join(F.broadcast(dealt), col(group) == F.col("__group")).drop("__group")  # one row per group
    inputs = [c for c in examples.columns if c not in (group, label)]
    rows = rows.select(*[col(c) for c in [*inputs, label, group]], "fold")  # inputs first: they are numbered in order
    parts = []
    for k in range(folds):
        seen, held = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        model = train_classifier(seen.drop("fold", group), label, **forest)
        if model is None:
            parts.append(held.withColumn("predicted", F.lit(None).cast("string")))
            continue
        judged = predict(model, held.drop("fold"), label)
        parts.append(judged.withColumn("fold", F.lit(k)).select(*rows.columns, "predicted"))
    return reduce(DataFrame.unionByName, parts)


def _prepare(df: DataFrame, label: str, with_label: bool = True) -> tuple[DataFrame, list[tuple[str, str]]]:
    kind = kinds(df)
    added, inputs = {}, []
    for i, c in enumerate(x for x in df.columns if x not in (label, "weight")):
        if kind[c] in ("string", "boolean"):
            added[f"__t{i}"] = F.coalesce(col(c).cast("string"), F.lit("\0missing"))
            inputs.append((f"__t{i}", "text"))
        elif kind[c] == "number":
            added[f"__x{i}"] = F.coalesce(col(c).cast("double"), F.lit(0.0))
            added[f"__m{i}"] = col(c).isNull().cast("double")
            inputs += [(f"__x{i}", "number"), (f"__m{i}", "number")]
    if with_label:
        added["__label"] = col(label).cast("string")
    return df.withColumns(added), inputs
