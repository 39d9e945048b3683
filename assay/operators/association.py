"""How strongly each feature goes with the target: mutual information, Pearson, Spearman."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import checkpoint_folder
from ..settings import DEFAULTS, Settings
from .columns import chunks, col, long_form, missing_as_null, numeric
from .order_stats import count_present, equal_count_edges, in_bins, quantiles
from .ranks import average_rank, cumulative, cumulative_counts
from ..functions import safe_corr


HOT_VALUES = 1000  # a target value of more than this share of the rows is joined by broadcast


@dataclass(frozen=True)
class Feature:
    """A column and how it enters the measures."""

    name: str
    kind: str  # physical kind
    numeric: bool
    nullable: bool = True
    n_unique: int | None = None


@dataclass(frozen=True)
class Target:
    name: str
    kind: str
    classes: bool  # labels rather than a quantity
    n_unique: int = 0


@dataclass
class Encoded:
    """Rows with a target: ``y`` and one double column per feature."""

    df: DataFrame
    columns: dict[str, str] = field(default_factory=dict)


def eligible(row: Row, target: str) -> bool:
    """Can this profile row be tested for leakage by association?"""
    if row["column"] == target or row["is_id_like"] or row["is_high_cardinality"]:
        return False
    if row["dtype_inferred"] != "numeric" and row["cardinality_ratio"] >= 0.5:
        return False
    return row["dtype_inferred"] in ("numeric", "categorical", "boolean")


def is_class_target(row: Row, settings: Settings = DEFAULTS) -> bool:
    return row["dtype_inferred"] in ("categorical", "boolean", "id") or (
        row["dtype_inferred"] == "numeric" and (row["n_unique"] or 0) <= settings.class_values
    )


def describe_columns(rows: list[Row], target: str, settings: Settings = DEFAULTS) -> tuple[list[Feature], Target]:
    """Features and target from collected profile rows."""
    t = next(r for r in rows if r["column"] == target)
    features = [
        Feature(r["column"], r["kind"], r["dtype_inferred"] == "numeric", r["n_null"] > 0, r["n_unique"])
        for r in rows
        if eligible(r, target)
    ]
    return features, Target(target, t["kind"], is_class_target(t, settings), t["n_unique"] or 0)


def with_target(df: DataFrame, target: Target) -> DataFrame:
    df = missing_as_null(df)
    present = col(target.name) if target.classes else numeric(target.name, target.kind)
    return df.filter(present.isNotNull())


def level_codes(df: DataFrame, names: list[str], rows: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """``column, level, code``: position of each level among the sorted levels of its column.

    Levels of numeric columns sort as numbers, others as text. Columns of one type share a scan and a grouping.
    """
    by_type: dict[str, list[str]] = {}
    for name in names:
        by_type.setdefault(df.schema[name].dataType.simpleString(), []).append(name)
    parts = []
    for members in by_type.values():
        typed = long_form(df, {n: col(n) for n in members}).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(cumulative(typed, rows, settings).select("column", F.col("value").cast("string").alias("level"), "code"))
    return reduce(DataFrame.unionByName, parts)


def encode(df: DataFrame, features: list[Feature], target: Target, settings: Settings = DEFAULTS) -> Encoded:
    """Numbers stay, labels become codes by value order, a missing label becomes -1.

    Features with labels have few levels (that is what makes them eligible), so
    their codes are a lookup expression. The target's codes are one too up to
    ``broadcast_rows`` classes, and a join beyond.
    """
    rows = with_target(df, target)
    labelled = [f.name for f in features if not f.numeric]
    lookups: dict[str, Column] = {}
    if labelled:
        levels: dict[str, dict[str, int]] = {n: {} for n in labelled}
        for r in level_codes(rows, labelled, 1, settings).collect():
            levels[r["column"]][r["level"]] = r["code"]
        for name, table in levels.items():
            lookups[name] = _lookup(col(name).cast("string"), table)
    if not target.classes:
        rows = rows.withColumn("__y", numeric(target.name, target.kind))
    elif target.n_unique <= settings.class_values:
        codes = {r["level"]: r["code"] for r in level_codes(rows, [target.name], 1, settings).collect()}
        rows = rows.withColumn("__y", _lookup(col(target.name).cast("string"), codes))
    else:
        codes = level_codes(rows, [target.name], target.n_unique, settings).select(
            F.col("level").alias("__level"), F.col("code").cast("double").alias("__y")
        )
        if target.n_unique <= settings.broadcast_rows:
            codes = F.broadcast(codes)
        rows = rows.join(codes, col(target.name).cast("string") == F.col("__level"))
    values = [
        (numeric(f.name, f.kind) if f.numeric else F.coalesce(lookups[f.name], F.lit(-1.0))).alias(f"x{i}")
        for i, f in enumerate(features)
    ]
    return Encoded(
        rows.select(F.col("__y").alias("y"), *values), {f.name: f"x{i}" for i, f in enumerate(features)}
    )


def _lookup(value: Column, table: dict[str, int]) -> Column:
    if not table:
        return F.lit(None).cast("double")
    (level, code), *rest = table.items()
    out = F.when(value == F.lit(level), F.lit(float(code)))
    for level, code in rest:  # one flat CASE
        out = out.when(value == F.lit(level), F.lit(float(code)))
    return out


def pearson(encoded: Encoded, features: list[Feature], settings: Settings = DEFAULTS) -> DataFrame:
    """``column, n_pairs, n_equal, r`` against the target, one aggregate for up to 200 features."""
    spark = encoded.df.sparkSession
    out = spark.createDataFrame([], "column string, n_pairs bigint, n_equal bigint, r double")
    for part in chunks(features, settings.pairs_per_aggregate):
        sums, rows = [], []
        for f in part:
            x = F.col(encoded.columns[f.name])
            tag = encoded.columns[f.name]
            sums += [
                F.count(x).alias(f"n_{tag}"),
                F.count_if(x == F.col("y")).alias(f"e_{tag}"),
                safe_corr(x, F.col("y")).alias(f"r_{tag}"),
            ]
            rows.append(
                F.struct(
                    F.lit(f.name).alias("column"), F.col(f"n_{tag}").alias("n_pairs"),
                    F.col(f"e_{tag}").alias("n_equal"), F.col(f"r_{tag}").alias("r"),
                )
            )
        out = out.unionByName(encoded.df.agg(*sums).select(F.inline(F.array(*rows))))
    return out


def _kept(counts: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """The counts, computed once: a local table while small, else written to the checkpoint folder."""
    spark = counts.sparkSession
    head = counts.limit(settings.broadcast_rows + 1).toArrow()
    if head.num_rows <= settings.broadcast_rows:
        return spark.createDataFrame(head, counts.schema), head.num_rows
    checkpoint_folder(spark)
    written = counts.checkpoint()
    return written, written.count()


def _join_by_value(df: DataFrame, ranks: DataFrame, hot: DataFrame, tasks: int) -> DataFrame:
    """``df`` with the ranks of its ``y``. The values in ``hot``, fewer than ``HOT_VALUES``, are broadcast; only the rows of others are exchanged.

    ``tasks`` follows the rows: in bytes these columns pack so well that a task of the usual size would sort tens of millions of rows.
    """
    checkpoint_folder(df.sparkSession)
    hot = df.sparkSession.createDataFrame(hot.toArrow(), hot.schema)
    known = ranks.join(F.broadcast(hot), "y")
    # Spark rewrites a key of floating numbers and would deal both sides anew: the key is a hash, the value a condition
    key, other = F.xxhash64("y").alias("__key"), [c for c in ranks.columns if c != "y"]
    left = df.join(F.broadcast(hot), "y", "left_anti").select("*", key).repartition(tasks, "__key")
    right = ranks.select(F.xxhash64("y").alias("__of"), F.col("y").alias("__y"), *other).repartition(tasks, "__of")
    same = (F.col("__key") == F.col("__of")) & (F.col("y") >= F.col("__y")) & (F.col("y") <= F.col("__y"))
    cold = left.join(right.hint("merge"), same).select("y", *[c for c in df.columns if c != "y"], *other)
    return df.join(F.broadcast(known.checkpoint()), "y").unionByName(cold)


@dataclass
class ClassTable:
    """What one feature's values tell about the classes: sums of its centred ranks, and rows per bin (or level) and class."""

    cells: dict[float, list[int]]
    present: int  # rows with a value
    xy: float
    xx: float
    yy: float


def value_classes(encoded: Encoded, features: list[Feature], classes: list[float], settings: Settings = DEFAULTS) -> DataFrame:
    """``column, value, n, class0, class1, ...``: rows of every value of every column of ``encoded``, in all and by class. A missing value is a row too.

    As in ``value_counts.counted``, every feature is scanned and grouped by itself. The counts are written to the checkpoint folder:
    the table is grouped once, whatever is asked of them.
    """
    of_class = [F.count_if(F.col("y") == y).alias(f"class{i}") for i, y in enumerate(classes)]
    sums = [F.count(F.lit(1)).alias("n"), *of_class]
    parts = []
    for group in chunks([encoded.columns[f.name] for f in features], max(settings.columns_per_grouping, -(-len(features) // settings.columns_per_aggregate))):
        if len(group) == 1:
            counts = encoded.df.select("y", F.col(group[0]).alias("value")).groupBy("value").agg(*sums).withColumn("column", F.lit(group[0]))
        else:
            counts = encoded.df.select("y", *group).unpivot(["y"], group, "column", "value").groupBy("column", "value").agg(*sums)
        parts.append(counts)
    checkpoint_folder(encoded.df.sparkSession)
    return reduce(DataFrame.unionByName, parts).checkpoint()


def class_tables(
    encoded: Encoded, features: list[Feature], classes: list[float], bins: int, settings: Settings = DEFAULTS
) -> dict[str, ClassTable]:
    """Per feature its ``ClassTable`` for a target of the values ``classes``, in their order; quantities fall into ``bins`` bins of equal counts.

    An edge is the value at place ``ceil(n*i/bins)``, so the edges below a value follow from the rows below it: ``below * bins div n``.
    A missing quantity falls where the median does. At most one row per feature and bin, or level, reaches the driver.
    """
    if not features:
        return {}
    spark = encoded.df.sparkSession
    values = value_classes(encoded, features, classes, settings)
    labels = [encoded.columns[f.name] for f in features if not f.numeric]
    each = [f"class{i}" for i in range(len(classes))]
    given = F.col("value").isNotNull()
    totals = values.groupBy("column").agg(
        F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(given, F.col("n"))), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(F.when(given, F.col(c))), F.lit(0)).alias(c) for c in each],
        *[F.coalesce(F.sum(F.when(~given, F.col(c))), F.lit(0)).alias(f"{c}_missing") for c in each],
    ).collect()  # one row per feature
    found, facts = {}, []
    for r in totals:
        n, below, ranks = r["n"], 0, []
        for c in each:
            ranks.append((below + (r[c] + 1) / 2 - (n + 1) / 2) / n if n else 0.0)
            below += r[c]
        found[r["column"]] = ClassTable({}, n, 0.0, 0.0, sum(r[c] * x * x for c, x in zip(each, ranks)))
        facts.append((r["column"], n, r["column"] in labels, (n - 1) // 2, n // 2, ranks))
    table = spark.createDataFrame(facts, "column string, total bigint, label boolean, low bigint, high bigint, ranks array<double>")
    ranked = cumulative(values.where(given), sum(r["distinct"] for r in totals), settings).join(F.broadcast(table), "column")  # one row per feature
    at = lambda place: F.max(F.when((F.col("below") <= F.col(place)) & (F.col(place) < F.col("below") + F.col("n")), F.col("value")))
    rx = (average_rank() - (F.col("total") + 1) / 2) / F.col("total")
    ry = reduce(Column.__add__, [F.col(c) * F.get("ranks", F.lit(i)) for i, c in enumerate(each)])
    x = F.when(F.col("label"), F.col("value")).otherwise(F.expr(f"(below * {bins}) div total").cast("double"))
    cells = ranked.withColumns({"x": x, "rx": rx, "s": ry}).groupBy("column", "x").agg(
        *[F.sum(c).alias(c) for c in each], F.sum(F.col("rx") * F.col("s")).alias("xy"), F.sum(F.col("rx") * F.col("rx") * F.col("n")).alias("xx"),
        at("low").alias("low"), at("high").alias("high"),
    ).collect()
    middle: dict[str, dict[str, tuple[float, float]]] = {}
    for r in sorted(cells, key=lambda r: (r["column"], r["x"])):
        own = found[r["column"]]
        own.cells[r["x"]] = [r[c] for c in each]
        own.xy, own.xx = own.xy + r["xy"], own.xx + r["xx"]
        middle.setdefault(r["column"], {}).update({k: (r["x"], r[k]) for k in ("low", "high") if r[k] is not None})
    for r in totals:
        missing = [r[f"{c}_missing"] for c in each]
        if any(missing):
            cell = _median_cell(**middle[r["column"]]) if r["n"] else 0.0
            own = found[r["column"]].cells
            own[cell] = [a + b for a, b in zip(own.get(cell, [0] * len(each)), missing)]
    return {f.name: found[encoded.columns[f.name]] for f in features if encoded.columns[f.name] in found}


def _median_cell(low: tuple[float, float], high: tuple[float, float]) -> float:
    """The bin of the median, given bin and value of the one or two middle rows: a median between two values lies above every edge that is the lower."""
    return low[0] if low[1] == high[1] or low[1] + (high[1] - low[1]) * 0.5 == low[1] else high[0]


def _few_classes(encoded: Encoded, target: Target, settings: Settings) -> tuple[Encoded, dict[float, int]] | None:
    """The rows with few classes as ``y``, a quantity's being its bins of equal counts, and the rows of each; None if they are many."""
    rows = encoded.df
    if target.classes:
        if target.n_unique > settings.class_values:
            return None
    else:
        n = count_present(rows, {"\0y": F.col("y")}, settings)
        bins = bin_count(n["\0y"], target, settings)
        if bins > settings.class_values:
            return None
        known = {"\0y": target.n_unique} if target.n_unique else None
        edges = equal_count_edges(long_form(rows, {"\0y": F.col("y")}), bins, n, settings, known)
        rows = in_bins(rows, {"y": edges.get("\0y", [])})
    found = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(settings.class_values + 1).collect()
    if not 0 < len(found) <= settings.class_values:
        return None
    return Encoded(rows, encoded.columns), {r["y"]: r["n"] for r in found}


def _monotonic(tables: dict[str, ClassTable], spark) -> DataFrame:
    """``column, rho`` of ``class_tables``."""
    found = [(c, t.xy / size if (size := math.sqrt(t.xx) * math.sqrt(t.yy)) else None) for c, t in tables.items() if t.present]
    return spark.createDataFrame(found, "column string, rho double")


def _information(tables: dict[str, ClassTable], features: list[Feature], target: Target, spark, settings: Settings) -> DataFrame:
    """``column, n, mi, h_target, mi_norm, one_to_one`` of ``class_tables``; the terms are those of ``mutual_information``."""
    xlogx = lambda counts: math.fsum(c * math.log(c) for c in counts if c)
    labels = {f.name for f in features if not f.numeric}
    rows = []
    for name, t in tables.items():
        joint = [c for cell in t.cells.values() for c in cell if c]
        by_value, by_class = [sum(cell) for cell in t.cells.values()], [c for c in map(sum, zip(*t.cells.values())) if c]
        n = sum(joint)
        h_y = math.log(n) - xlogx(by_class) / n if n else 0.0
        mi = max(0.0, math.log(n) + (xlogx(joint) - xlogx(by_value) - xlogx(by_class)) / n) if n else 0.0
        enough = n >= 20 and (len(by_class) >= 2 or not target.classes)
        same = target.classes and name in labels and len(by_value) == len(by_class) == len(joint)
        rows.append((name, n, mi, enough, h_y, same))
    if not target.classes and settings.mi_norm == "max":
        norm = max([r[2] for r in rows] + [1e-9])
    else:
        norm = None
    scale = lambda h: norm or (h if h > 1e-9 else 1.0)
    return spark.createDataFrame(
        [(name, n, mi if enough else None, h, mi / scale(h) if enough else None, same) for name, n, mi, enough, h, same in rows],
        "column string, n bigint, mi double, h_target double, mi_norm double, one_to_one boolean",
    )


def spearman(encoded: Encoded, features: list[Feature], settings: Settings = DEFAULTS) -> DataFrame:
    """``column, rho``: Pearson correlation of average ranks, per feature over its present rows.

    The target's distinct values carry one count of all rows and one of every feature with gaps, so all their ranks come from one
    grouping and one pass in order. The ranks are joined by the target to the wide rows, before they are multiplied by features; those of
    target values that many rows share are sent to the rows, so no task holds all rows of such a value. Rows are then grouped by (feature, value) with
    the sum of the target's ranks, so a frequent value is one row when the feature itself is ranked. A target of up to ``class_values`` values
    needs no join: the counts of ``class_tables`` hold all that is asked.
    """
    df = encoded.df
    xs = {f.name: F.col(encoded.columns[f.name]) for f in features}
    gappy = {f.name: f"n{i}" for i, f in enumerate(features) if f.nullable and f.numeric}
    counts = df.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.count(xs[name]).alias(c) for name, c in gappy.items()])
    y_counts, size = _kept(counts, settings)
    if 0 < size <= settings.class_values:
        classes = sorted(r["y"] for r in y_counts.select("y").collect())
        return _monotonic(class_tables(encoded, features, classes, 1, settings), df.sparkSession)
    kinds_of_rank = ["n", *gappy.values()]
    totals = y_counts.agg(*[F.sum(c).cast("double").alias(c) for c in kinds_of_rank]).first()
    placed = cumulative_counts(y_counts, "y", kinds_of_rank, size, settings)
    ranks = placed.select("y", *[
        F.try_divide(F.col(f"below_{c}") + (F.col(c) + 1) / 2 - F.lit(((totals[c] or 0.0) + 1) / 2), F.lit(totals[c] or 0.0)).alias(f"r_{c}") for c in kinds_of_rank])
    if size <= settings.broadcast_rows:
        wide = df.join(F.broadcast(ranks), "y")
    else:
        tasks = math.ceil(4 * totals["n"] / settings.exact_in_one_pass)
        wide = _join_by_value(df, ranks, y_counts.where(F.col("n") * HOT_VALUES > F.lit(totals["n"])).select("y"), tasks)
    pair = {name: F.when(x.isNotNull(), F.struct(x.alias("x"), F.col(f"r_{gappy.get(name, 'n')}").alias("ry"))) for name, x in xs.items()}
    grouped = long_form(wide, pair).groupBy("column", F.col("value.x").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value.ry").alias("s"), F.sum(F.col("value.ry") * F.col("value.ry")).alias("q"))
    both = cumulative(grouped, None, settings)  # written once: ranks and totals are both taken from it
    per_feature = both.groupBy("column").agg(F.sum("n").cast("double").alias("total"))
    centred = (average_rank() - (F.col("total") + 1) / 2) / F.col("total")
    sums = (
        both.join(F.broadcast(per_feature), "column")  # one row per feature
        .withColumn("rx", centred)
        .groupBy("column")
        .agg(
            F.sum(F.col("rx") * F.col("s")).alias("xy"),
            F.sum(F.col("rx") * F.col("rx") * F.col("n")).alias("xx"),
            F.sum("q").alias("yy"),
        )
    )
    return sums.select("column", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("rho"))


def bin_count(n: int, target: Target, settings: Settings = DEFAULTS) -> int:
    """Bins per quantity: about five rows per cell, between 2 and ``mi_bins``."""
    fitting = n // (5 * max(target.n_unique, 1)) if target.classes else math.isqrt(n // 5)
    return max(2, min(settings.mi_bins, fitting))


def mutual_information(
    encoded: Encoded, features: list[Feature], target: Target, settings: Settings = DEFAULTS
) -> DataFrame:
    """``column, n, mi, h_target, mi_norm, one_to_one`` in nats.

    Quantities enter in bins of equal counts (fewer of them when there are few
    rows per class, as empty cells look like information), labels by their codes;
    a missing label is its own class and a missing quantity takes the median. All
    features share one scan and one grouping by (feature, value, class).
    ``one_to_one`` says that a label feature and the classes are the same
    partition of the rows.
    """
    rows = encoded.df
    if few := _few_classes(encoded, target, settings):
        classed, counts = few
        bins = bin_count(sum(counts.values()), target, settings)
        return _information(class_tables(classed, features, sorted(counts), bins, settings), features, target, rows.sparkSession, settings)
    quantities = {f.name: F.col(encoded.columns[f.name]) for f in features if f.numeric}
    if not target.classes:
        quantities["\0y"] = F.col("y")
    edges: dict[str, list[float]] = {}
    medians: dict[str, list[float]] = {}
    if quantities:
        counts = count_present(rows, {**quantities, "\0rows": F.lit(1)}, settings)
        bins = bin_count(counts.pop("\0rows"), target, settings)
        known = {f.name: f.n_unique for f in features if f.n_unique is not None}
        if not target.classes:
            known["\0y"] = target.n_unique
        edges = equal_count_edges(long_form(rows, quantities), bins, counts, settings, known)
        gappy = {f.name: quantities[f.name] for f in features if f.numeric and f.nullable}
        if gappy:
            medians = quantiles(long_form(rows, gappy), [0.5], {k: counts.get(k, 0) for k in gappy}, settings, known)
    filled = {
        encoded.columns[f.name]: F.coalesce(quantities[f.name], F.lit(medians.get(f.name, [-1.0])[0]))
        for f in features
        if f.numeric and f.nullable
    }
    cuts = {encoded.columns[f.name]: edges.get(f.name, []) for f in features if f.numeric}
    if not target.classes:
        cuts["y"] = edges.get("\0y", [])
    binned = in_bins(rows.withColumns(filled) if filled else rows, cuts)
    values = {f.name: F.col(encoded.columns[f.name]) for f in features}
    joint = (
        long_form(binned, values, value="x", keep={"y": F.col("y")})
        .groupBy("column", "x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def xlogx(c: Column) -> Column:
        return c * F.ln(c)

    by_value = joint.groupBy("column", "x").agg(
        F.sum("n").alias("nx"), F.sum(xlogx(F.col("n").cast("double"))).alias("jx"), F.count(F.lit(1)).alias("k")
    )
    by_feature = by_value.groupBy("column").agg(
        F.sum("nx").alias("n"),
        F.sum(xlogx(F.col("nx").cast("double"))).alias("sx"),
        F.sum("jx").alias("sxy"),
        F.count(F.lit(1)).alias("kx"),
        F.sum("k").alias("kxy"),
    )
    sums = (  # one row
        binned.groupBy("y")
        .agg(F.count(F.lit(1)).cast("double").alias("ny"))
        .agg(F.sum(xlogx(F.col("ny"))).alias("sy"), F.sum("ny").alias("total"), F.count(F.lit(1)).alias("ky"))
        .first()
    )
    n, s_y, classes = F.col("n"), sums["sy"] or 0.0, sums["ky"]
    h_y = math.log(sums["total"]) - s_y / sums["total"] if sums["total"] else 0.0
    # ln(n) + (sum of joint - sum of x - sum of y) / n
    mi = F.greatest(F.lit(0.0), F.ln(n) + (F.col("sxy") - F.col("sx") - F.lit(s_y)) / n)
    out = by_feature.select(
        "column", "n", mi.alias("mi"), F.lit(h_y).alias("h_target"), "kx", "kxy", F.lit(classes).alias("ky")
    )
    if not target.classes and settings.mi_norm == "max":
        norm = max(out.agg(F.max("mi")).first()[0] or 0.0, 1e-9)
    else:
        norm = h_y if h_y > 1e-9 else 1.0
    out = out.withColumn("norm", F.lit(norm))
    labels = [f.name for f in features if not f.numeric]
    one_to_one = (F.col("kx") == F.col("kxy")) & (F.col("ky") == F.col("kxy")) & F.col("column").isin(labels)
    enough = (F.col("n") >= 20) & ((F.col("ky") >= 2) | F.lit(not target.classes))
    return out.select(
        "column", "n", F.when(enough, F.col("mi")).alias("mi"), "h_target",
        F.when(enough, F.col("mi") / F.col("norm")).alias("mi_norm"),
        (one_to_one & F.lit(target.classes)).alias("one_to_one"),
    )


def target_association(
    df: DataFrame, features: list[Feature], target: Target, settings: Settings = DEFAULTS
) -> DataFrame:
    """``column, n_pairs, exact, mi, corr, spearman`` for every feature."""
    encoded = encode(df, features, target, settings)
    linear = pearson(encoded, features, settings)
    if target.classes and (few := _few_classes(encoded, target, settings)):
        bins, spark = bin_count(sum(few[1].values()), target, settings), df.sparkSession
        tables = class_tables(encoded, features, sorted(few[1]), bins, settings)  # both measures from one grouping
        monotonic, information = _monotonic(tables, spark), _information(tables, features, target, spark, settings)
    else:
        monotonic, information = spearman(encoded, features, settings), mutual_information(encoded, features, target, settings)
    enough = F.col("n_pairs") >= 10
    labels = [f.name for f in features if not f.numeric]
    exact = F.when(
        F.lit(target.classes) & F.col("column").isin(labels), F.col("one_to_one")
    ).otherwise(F.col("n_equal") == F.col("n_pairs"))
    return (
        linear.join(monotonic, "column", "left")
        .join(information.select("column", "mi_norm", "one_to_one"), "column", "left")
        .select(
            "column",
            "n_pairs",
            (enough & F.coalesce(exact, F.lit(False))).alias("exact"),
            F.coalesce("mi_norm", F.lit(0.0)).alias("mi"),
            F.coalesce(F.when(enough, F.abs("r")), F.lit(0.0)).alias("corr"),
            F.coalesce(F.when(enough, F.abs("rho")), F.lit(0.0)).alias("spearman"),
        )
    )
