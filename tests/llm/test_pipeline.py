"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute_kept
from test_text_operators import check_pieces, library_ids

import corpus_pipeline
from assay.llm import crf, secrets
from assay.llm._shared import saved, table
from assay.llm.queries import QUERIES, SQL
from compare import connect


@pytest.fixture(scope="module")
def chain(spark, small):
    """Documents and what every stage made of them."""
    docs, out = table(spark, small, "documents"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, small), f"test-{name}")
        out.append(docs)
    return out


def rows_of(df) -> dict:
    return {r.doc_id: r for r in df.collect()}


def test_stages_and_columns(chain):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language", "near_duplicates", "secret_scan", "packing"]
    for docs in chain[1:5]:
        assert docs.dtypes == chain[0].dtypes


def test_quality_stage(chain, small):
    kept = connect(small).execute(f"SELECT doc_id FROM ({SQL['op7_adaptive_quality']}) WHERE kept").fetchall()
    assert rows_of(chain[1]) == {d: r for d, r in rows_of(chain[0]).items() if (d,) in set(kept)}


def test_language_stage(chain):
    labeller = crf.Labeller(crf.train(chain[1]))
    before = rows_of(chain[1])
    posterior, counts = labeller.words([r.text for r in before.values()])
    sure = [part.max(axis=1).mean() if len(part) else 0.0 for part in np.split(posterior, np.cumsum(counts)[:-1])]
    assert rows_of(chain[2]) == {d: r for (d, r), s in zip(before.items(), sure) if s >= 0.4}


def test_unlabelled_input_keeps_its_texts(spark, chain):
    docs = chain[1].withColumn("lang", F.lit(None).cast("string"))
    letters = {d for d, r in rows_of(docs).items() if any(c.isalpha() for c in r.text)}
    assert rows_of(corpus_pipeline.language(spark, docs, "")).keys() == letters


def test_evenly_switching_texts_stay(spark, chain):
    model = crf.train(chain[1])
    by_lang = {}
    for r in rows_of(chain[1]).values():
        by_lang.setdefault(r.lang, r.text)
    text = " ".join(w for ws in zip(*[t.split()[:40] for k, t in sorted(by_lang.items(), key=str) if k]) for w in ws)
    docs = spark.createDataFrame([(1, text), (2, "² ½ Ⅷ 12"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in crf.keep_clear(docs, model).collect()] == [1]


def test_near_duplicate_stage(chain):
    before = rows_of(chain[2])
    kept = brute_kept({d: r.text for d, r in before.items()})
    assert rows_of(chain[3]) == {d: r for d, r in before.items() if d in kept}


def test_secret_stage(chain):
    pattern = re.compile(secrets.CANDIDATE)
    after = rows_of(chain[4])
    for d, r in rows_of(chain[3]).items():  # in these tables the only candidates without a secret are plain numbers
        text = pattern.sub(lambda m: m.group() if m.group().isdigit() else secrets.MASK, r.text)
        assert after[d].text == text and after[d].n_chars == len(text) and (after[d].lang, after[d].source) == (r.lang, r.source)
    assert len(after) == chain[3].count()


def test_packing_stage(chain):
    docs = rows_of(chain[4])
    ids = library_ids("byte_bpe_50k.json", [r.text for r in docs.values()])
    check_pieces(chain[5].collect(), {d: [*i, 0] for d, i in zip(docs, ids)})


def test_run_is_the_chain(spark, small, chain):
    own = corpus_pipeline.run(spark, small)
    assert own.columns == chain[5].columns
    sizes = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert sizes(own) == sizes(chain[5])


def test_clean_documents_stay(chain, small):
    """Documents labelled good go only for a reason of their own: the base rule, no letters, or a copy with a smaller id."""
    good = {d for (d,) in duckdb.sql(f"SELECT doc_id FROM '{small}/labels.parquet' WHERE quality = 1").fetchall()}
    base = {r.doc_id for r in QUERIES["op7_adaptive_quality"](chain[0].sparkSession, small).where("base_failed").collect()}
    kept = rows_of(chain[2])
    assert good - base <= kept.keys()


def test_edge_rows_pass_through(spark, edge, small):
    docs = edge.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, small), f"test-{name}")
        assert docs.columns == [*edge.columns, "n_chars"]
    assert docs.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
