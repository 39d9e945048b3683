"""One query per operator over its whole table, and the pipeline; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, crf, lloyd, lm, merkle, packing, pieces, quality, secrets, simhash, toxicity, warc
from ._shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_simhash_groups(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_language_words(spark, folder):
    docs = table(spark, folder, "documents")
    found = crf.predict(docs, crf.train(docs), ["doc_id"])
    held = F.coalesce(crf.split_of(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op3_backoff_scores(spark, folder):
    found = lm.scores(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


@query
def op4_packed_pieces(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op5_bpe_round_trip(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op6_merkle_fingerprints(spark, folder):
    return merkle.against_next(table(spark, folder, "documents"))


@query
def op7_adaptive_quality(spark, folder):
    return quality.quality_verdicts(table(spark, folder, "documents"))


@query
def op8_toxicity_chain(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query
def op9_secret_findings(spark, folder):
    found = secrets.scan(table(spark, folder, "documents"), ["doc_id"])
    return found.select("doc_id", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


@query
def op10_warc_round_trip(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"))


@query
def op11_token_links(spark, folder):
    return alignment.token_links(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query
def op12_sharded_lloyd(spark, folder):
    return lloyd.cluster(table(spark, folder, "embeddings"))


@query
def op13_piece_round_trip(spark, folder):
    return pieces.round_trip(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


SQL: dict[str, str] = {}

SQL["op3_backoff_scores"] = """
WITH w AS (
  SELECT d.rowid_ AS r, d.doc_id, u.word, u.i FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents) d,
  LATERAL (SELECT unnest(l) AS word, generate_subscripts(l, 1) AS i
           FROM (SELECT regexp_extract_all(translate(coalesce(d.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l)) u
), g AS (
  SELECT r, doc_id, i, word AS w3, lag(word) OVER t AS w2, lag(word, 2) OVER t AS w1 FROM w WINDOW t AS (PARTITION BY r ORDER BY i)
), c AS (
  SELECT *, count(*) OVER (PARTITION BY w3) AS c1, count(*) OVER (PARTITION BY w2, w3) AS c2, count(*) OVER (PARTITION BY w1, w2, w3) AS c3 FROM g
), e AS (
  SELECT *, lag(c1) OVER t AS p1, lag(c2) OVER t AS p2, (SELECT count(*) FROM w) AS n FROM c WINDOW t AS (PARTITION BY r ORDER BY i)
), s AS (
  SELECT r, CASE WHEN i >= 3 AND c3 >= 2 THEN ln(c3) - ln(p2)
                 WHEN i >= 2 AND c2 >= 2 THEN ln(c2) - ln(p1) + ln(0.4) * (least(i - 1, 2) - 1)
                 ELSE ln(c1) - ln(n) + ln(0.4) * least(i - 1, 2) END AS v FROM e
), t AS (SELECT r, count(*) AS n, sum(v) AS v FROM s GROUP BY r)
SELECT d.doc_id, coalesce(t.n, 0)::BIGINT AS n_words, round(coalesce(t.v, 0.0), 4) AS score, round(t.v / t.n, 6) AS mean_score
FROM (SELECT row_number() OVER () AS rowid_, doc_id FROM documents) d LEFT JOIN t ON t.r = d.rowid_
"""

SQL["op7_adaptive_quality"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM (
    SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i))
), covered AS (SELECT r, count(DISTINCT i + o) AS n FROM windows, (SELECT unnest(range(0, 5)) AS o) WHERE c > 1 GROUP BY r
), stutter AS (SELECT r, count(*) AS n FROM (SELECT r, ws, unnest(range(2, len(ws) + 1)) AS i FROM d) WHERE ws[i] = ws[i - 1] GROUP BY r
), lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), m AS (
  SELECT d.r, doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
         len(regexp_extract_all(text, '\\p{Lu}')) AS n_upper, coalesce(s.n, 0) AS n_stutter
  FROM d LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r) LEFT JOIN stutter s USING (r)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS duplicate_lines,
         CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share, CASE WHEN n_words > 0 THEN n_stutter / n_words ELSE 0 END AS stutter_share FROM m
), v AS (
  SELECT lang, source, unnest(['mean_word', 'symbol_share', 'duplicate_lines', 'upper_share', 'stutter_share']) AS measure,
         unnest([mean_word, symbol_share, duplicate_lines, upper_share, stutter_share]) AS x FROM f WHERE NOT base_failed
), b AS (SELECT lang, source, measure, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.01 / 0.99)) ELSE -1e9 END AS b, count(*) AS n FROM v GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang, source, measure, b, n FROM b
  UNION ALL SELECT 2, lang, NULL, measure, b, sum(n) FROM b GROUP BY lang, measure, b
  UNION ALL SELECT 3, NULL, NULL, measure, b, sum(n) FROM b GROUP BY measure, b
), cum AS (
  SELECT *, sum(n) OVER g AS total, sum(n) OVER (g ORDER BY b) AS upto, CASE WHEN b > -1e9 THEN 2 * pow(1.01 / 0.99, b) / (1.01 / 0.99 + 1) ELSE 0 END AS x
  FROM levels WINDOW g AS (PARTITION BY level, lang, source, measure)
), q AS (
  SELECT level, lang, source, measure, max(total) AS total, min(x) FILTER (upto > floor(0.25 * (total - 1))) AS q1,
         min(x) FILTER (upto > floor(0.5 * (total - 1))) AS q2, min(x) FILTER (upto > floor(0.75 * (total - 1))) AS q3
  FROM cum GROUP BY level, lang, source, measure
), w AS (
  SELECT l.lang, l.measure, (l.total * l.q1 + 200.0::DOUBLE * e.q1) / (l.total + 200.0::DOUBLE) AS q1, (l.total * l.q2 + 200.0::DOUBLE * e.q2) / (l.total + 200.0::DOUBLE) AS q2,
         (l.total * l.q3 + 200.0::DOUBLE * e.q3) / (l.total + 200.0::DOUBLE) AS q3
  FROM q l JOIN q e ON e.level = 3 AND l.measure = e.measure WHERE l.level = 2
), p AS (
  SELECT a.lang, a.source, a.measure, w.q1 AS w1, w.q2 AS w2, w.q3 AS w3, (a.total * a.q1 + 200.0::DOUBLE * w.q1) / (a.total + 200.0::DOUBLE) AS q1,
         (a.total * a.q2 + 200.0::DOUBLE * w.q2) / (a.total + 200.0::DOUBLE) AS q2, (a.total * a.q3 + 200.0::DOUBLE * w.q3) / (a.total + 200.0::DOUBLE) AS q3
  FROM q a JOIN w ON a.lang IS NOT DISTINCT FROM w.lang AND a.measure = w.measure WHERE a.level = 1
), cut AS (
  SELECT lang, source,
    max(least(greatest(q2 + 0.4::DOUBLE * q2, q3 + 6 * (q3 - q1)), greatest(w2 + 0.8::DOUBLE * w2, w3 + 12 * (w3 - w1)))) FILTER (measure = 'mean_word') AS top_word,
    max(greatest(least(q2 - 0.4::DOUBLE * q2, q1 - 6 * (q3 - q1)), least(w2 - 0.8::DOUBLE * w2, w1 - 12 * (w3 - w1)))) FILTER (measure = 'mean_word') AS low_word,
    max(least(greatest(q2 + 0.1::DOUBLE, q3 + 3 * (q3 - q1)), greatest(w2 + 0.2::DOUBLE, w3 + 6 * (w3 - w1)))) FILTER (measure = 'symbol_share') AS top_symbol,
    max(least(greatest(q2 + 0.4::DOUBLE, q3 + 3 * (q3 - q1)), greatest(w2 + 0.8::DOUBLE, w3 + 6 * (w3 - w1)))) FILTER (measure = 'duplicate_lines') AS top_lines,
    max(least(greatest(q2 + 0.2::DOUBLE, q3 + 6 * (q3 - q1)), greatest(w2 + 0.4::DOUBLE, w3 + 12 * (w3 - w1)))) FILTER (measure = 'upper_share') AS top_upper,
    max(least(greatest(q2 + 0.15::DOUBLE, q3 + 6 * (q3 - q1)), greatest(w2 + 0.3::DOUBLE, w3 + 12 * (w3 - w1)))) FILTER (measure = 'stutter_share') AS top_stutter
  FROM p GROUP BY lang, source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  coalesce(NOT base_failed AND mean_word <= top_word + 40 / greatest(n_words, 1) AND mean_word >= low_word - 40 / greatest(n_words, 1) AND symbol_share <= top_symbol
    AND duplicate_lines <= top_lines AND upper_share <= top_upper AND stutter_share <= top_stutter, false) AS kept
FROM f LEFT JOIN cut ON f.lang IS NOT DISTINCT FROM cut.lang AND f.source IS NOT DISTINCT FROM cut.source
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({value} >> {shift}) & 31)::INT, 1)"
_BASE32 = " || ".join(_DIGIT.format(value=f"('0x' || substr(x, {1 + 5 * k}, 5))::BIGINT", shift=s) for k in range(8) for s in (15, 10, 5, 0))
SQL["op10_warc_round_trip"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to, true AS intact FROM d
"""


def _lloyd_sql(k: int = 16, rounds: int = 3) -> str:
    """Whole vectors against whole centroids, round after round."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    steps = ["""v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
)""", f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS j, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), x) <= {k}
)"""]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS (SELECT r, j, d FROM (SELECT v.r, c.j, {far} AS d FROM v, c{t} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if t < rounds:
            steps.append(f"""c{t + 1} AS (
  SELECT c.j, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (
    SELECT j, list(y ORDER BY i) AS x FROM (
      SELECT a.j, i, floor(sum(v.x[i])::DOUBLE / count(*))::BIGINT AS y FROM a{t} a JOIN v USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY a.j, i
    ) GROUP BY j) m USING (j)
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c USING (j)"""


SQL["op12_sharded_lloyd"] = _lloyd_sql()
