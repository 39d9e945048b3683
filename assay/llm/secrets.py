"""Secret scans: candidate strings, and a random forest that removes false positives.

A candidate is a run of 16 or more letters, digits and ``_ + / = -`` with a digit in it, or whatever is assigned to a key name: all of
a quoted value, or all up to the next space, of any length and any characters. Texts are split at the candidates, which
gives each its place and its neighbours without any lookup. The forest sees its length, how its characters alternate (changes
between lower case, upper case, digits and signs, share of digits, distinct characters, all hexadecimal), how much of its letters
are words of the corpus, whether it lies in a path or address, and the words beside it (key names, assignments, quotes, words that
announce checksums and numbers).

Labelled findings come with the call, or from ``label``, which names only clear cases: an assignment to a key word is a secret; plain
numbers, paths, announced checksums and runs of corpus words are not. Everything else is left to the forest. Bounds: at most
``per_class`` labelled findings of each kind, the first in the order of a hash, and ``dictionary_size`` words, the most frequent of
all texts. Everything is DataFrame functions and Spark ML.

Defined results: null and empty texts have no finding; equal rows have equal findings; if the labelled findings lack a kind,
every finding gets the rule's answer (1.0 secret, 0.0 not, 0.5 open); other columns are not read; texts are scanned whole.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import saved

CANDIDATE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{16,}"
KEYS = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
BENIGN = r"(?i)(commit|sha-?[0-9]+|md5|checksum|digest|uuid|guid|etag|revision|version|isbn|order|invoice|phone|card)"
NEAR = 40  # characters looked at on either side
#: A key name with what may follow it up to the value. Look-behinds are bounded: 40 characters of name, 8 blanks.
NAME = KEYS + r"(s?([_-][A-Za-z0-9_-]{0,40}|[0-9]{0,4})|(?-i:[A-Z])[A-Za-z0-9]{0,20})"
NAMED = NAME + r"[\"'`]?[ \t]{0,8}[:=][ \t]{0,8}"
_QUOTED = "|".join(rf"(?<={NAMED}{q})[^{q}\n]+(?:(?<=\\){q}[^{q}\n]+){{0,20}}(?={q})" for q in "\"'`")
ASSIGNED = rf"(?<=[:= \t\"'`])(?<=[:=][ \t]{{0,8}}[\"'`]?)(?:{_QUOTED}|(?<={NAMED}[\"'`]?)[^\s\"'`:=]([^\s\"'`]*[^\s\"'`.,;:!?)\]}}>])?)"
#: A name in front of = is not of the value, if that is a key's or the value is a candidate without it.
_LONG = r"(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{16,}"
_START = r"(?:(?<![A-Za-z0-9_+/=-])|(?<==)(?<=(?:^|[^A-Za-z0-9_+/=-])[A-Za-z_][A-Za-z0-9_-]{0,60}=(?:[A-Za-z_][A-Za-z0-9_-]{0,60}=)?))"
_NAME = rf"{_START}(?=[A-Za-z0-9_+/=-]{{16}})(?![A-Za-z0-9_-]*{NAME}=[^=:\s])(?![A-Za-z_][A-Za-z0-9_-]{{0,60}}=(?!=){_LONG})"
#: Long parts joined by dots are one token; the first has a digit or is the start of a JSON web token.
_DOTTED = r"(?=[A-Za-z_-]*[0-9]|eyJ)[A-Za-z0-9_-]{16,}(?:\.[A-Za-z0-9_-]{6,}){1,100}"
FOUND = f"{ASSIGNED}|{_NAME}(?:{_DOTTED}|{CANDIDATE}|(?<==)(?!=){_LONG})"
#: Places of file paths, files and host names; user parts, queries and the path of an address are none of them.
PATH = r"(^|[\s\"'`(=])([A-Za-z]:|~|\.{1,2})?[/\\]([^\s?@:=\"'`]*[/\\.])?$"
HOST_BEFORE, HOST_AFTER = r"(://|www\.|^|[\s\"'`(])([A-Za-z0-9-]+\.)*(//)?$", r"^(\.[A-Za-z0-9-]+)*\.[a-z]{2,6}([/:?#\s\"'`,;)]|[.]?$)(?!\S*@)"
JSON_TOKEN = r"^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\."
MASK = "[SECRET]"
FEATURES = ("length", "changes", "digit_share", "distinct_share", "hexadecimal", "word_share", "in_path", "key_before", "benign_before", "assigned", "quoted")


def _pieces(text: Column) -> tuple[Column, Column]:
    """Texts between candidates (one more than candidates) and the candidates."""
    return F.split(text, FOUND, -1), F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and per candidate: k (its number in the text), start (code points ahead), value, before, after."""
    text = F.col(text_col).cast("string")
    rows = docs.where(text.rlike(FOUND)).select(*[F.col(c).alias(c) for c in keep], text.alias("_text"))
    between, found = _pieces(F.col("_text"))
    rows = rows.select(*keep, between.alias("_between"), F.posexplode(found).alias("k", "value"), found.alias("_found"))
    lengths = lambda array: F.aggregate(F.transform(array, lambda x: F.length(x)), F.lit(0), lambda total, n: total + n)
    start = lengths(F.slice("_between", F.lit(1), F.col("k") + 1)) + lengths(F.slice("_found", F.lit(1), F.col("k")))
    before = F.concat(F.when(F.col("k") > 0, F.lit(" ")).otherwise(F.lit("")), F.element_at("_between", F.col("k") + 1))
    return rows.select(*keep, "k", start.cast("long").alias("start"), "value", F.right(before, F.lit(NEAR)).alias("before"),
                       F.left(F.element_at("_between", F.col("k") + 2), F.lit(NEAR)).alias("after"))


def dictionary(docs: DataFrame, text_col: str = "text", size: int = 2000) -> list[str]:
    """The most frequent lower-case words of three to twelve letters over all texts: a top-k report of ``size`` words."""
    words = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(?<![\p{L}\p{N}])\p{L}{3,12}(?![\p{L}\p{N}])"), F.lit(0))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def measured(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with the features of every candidate."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    n = F.length(value)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "[_+/=-]", "_")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    letters = F.regexp_extract_all(F.lower(F.regexp_replace(value, "(?<=[a-z])(?=[A-Z])", "_")), F.lit("[a-z]{3,}"), F.lit(0))
    known = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    covered = F.aggregate(F.transform(letters, lambda w: F.when(F.array_contains(known, w), F.length(w)).otherwise(F.lit(0))), F.lit(0), lambda total, k: total + k)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.withColumns({
        "length": n.cast("double"),
        "changes": (runs - 1) / n,
        "digit_share": F.regexp_count(value, F.lit("[0-9]")) / n,
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hexadecimal": flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "word_share": covered / n,
        "in_path": flag(before.rlike(PATH) | ((before.rlike(HOST_BEFORE) | value.startswith("//")) & after.rlike(HOST_AFTER)) | value.rlike("^/([a-z_-]+/)+")),
        "key_before": flag(before.rlike(KEYS)),
        "benign_before": flag(before.rlike(BENIGN + r"\W*$")),
        "assigned": flag(before.rlike(r"[:=]\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
    })


def label() -> Column:
    """1 and 0 for clear cases, null for the rest."""
    secret = F.col("before").rlike(f"{NAMED}[\"'`]?$") & (F.col("digit_share") < 1) & (F.col("word_share") < 0.6) \
        & ((F.col("digit_share") > 0) | (F.col("quoted") == 1) | (F.col("length") >= 16))
    plain = (F.col("digit_share") == 1) | (F.col("in_path") == 1) | (F.col("benign_before") == 1) | (F.col("word_share") >= 0.6)
    return F.when(secret | F.col("value").rlike(JSON_TOKEN), 1).when(plain, 0)


def train(findings: DataFrame, label_col: str = "label", per_class: int = 2000, trees: int = 30, depth: int = 5, seed: int = 11):
    """A forest fitted on labelled findings (``measured``, with ``label_col``), or None if a kind is missing."""
    known = findings.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("int").alias("label"), *FEATURES, F.xxhash64("value", "before", "after").alias("_h"))
    picks = [known.where(F.col("label") == k).distinct().orderBy("_h", *FEATURES).limit(per_class) for k in (0, 1)]
    sample = saved(picks[0].unionByName(picks[1]), "secrets-sample")
    kinds = {r["label"] for r in sample.select("label").distinct().collect()}
    if kinds != {0, 1}:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.repartition(1).sortWithinPartitions("label", "_h", *FEATURES))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return forest.fit(rows.select("features", F.col("label").cast("double")))


def scored(findings: DataFrame, model, cutoff: float = 0.5) -> DataFrame:
    """``findings`` with ``probability`` and ``is_secret``."""
    own = findings.columns
    if model is None:
        out = findings.withColumn("probability", F.coalesce(label().cast("double"), F.lit(0.5)))
    else:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(findings)
        model = model.copy().setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_class")
        out = model.transform(rows).select(*own, vector_to_array("_p")[1].alias("probability"))
    return out.withColumn("is_secret", F.col("probability") >= cutoff)


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", dictionary_size: int = 2000, cutoff: float = 0.5) -> DataFrame:
    """All candidates of all texts: ``keep``, k, start, value, before, after, features, probability, is_secret."""
    found = candidates(docs, keep, text_col)
    found = saved(measured(found, dictionary(docs, text_col, dictionary_size)), "secrets-findings")
    return scored(found, train(found.withColumn("label", label())), cutoff)


def redact(docs: DataFrame, text_col: str = "text", dictionary_size: int = 2000, cutoff: float = 0.5) -> DataFrame:
    """The same rows and columns, with every secret in ``text_col`` replaced by ``MASK``."""
    rows = saved(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("no")), "secrets-rows")
    flat = rows.select("no", F.col(f"row.`{text_col}`").alias("text"))
    hits = scan(flat, ["no"], "text", dictionary_size, cutoff).where("is_secret").groupBy("no").agg(F.collect_list("k").alias("hits"))
    hits = saved(hits, "secrets-hits")
    between, found = _pieces(F.col(f"row.`{text_col}`").cast("string"))
    parts = F.zip_with(between, found, lambda text, value: F.struct(text.alias("text"), value.alias("value")))
    kept = F.transform(parts, lambda p, k: F.concat(p["text"], F.coalesce(F.when(F.array_contains("hits", k), F.lit(MASK)), p["value"], F.lit(""))))
    text = F.when(F.col("hits").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(kept, ""))
    return rows.join(hits, "no", "left").select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")
