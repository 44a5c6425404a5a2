"""The registered queries: schemas, SQL twins, and the pipeline's stages."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vocspark.llm import queries, sql

from .conftest import frame
from .test_corpus_operators import plain_components, plain_removed

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_source_mixing": "doc_id size source_size target taken",
    "op5_ngram_join": "doc_id n_shingles component_id",
    "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_nearest_vectors": "query_id rank vec_id score",
    "op9_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10_html_text": "page_id url text n_chars",
    "op11_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_centroid_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_quality_classifier": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    out = entry.queries()[name](spark, SF)
    assert out.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    table = "embeddings" if name.startswith(("op8", "op12")) else "pages" if name.startswith("op10") else "documents"
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    assert out.count() == (20 * whole.where("vec_id % 20 = 0").count() if name.startswith("op8") else whole.count())


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_sql_twin(spark, duck, name):
    own = queries.QUERIES[name](spark, SF).toPandas()
    twin = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(twin.columns)
    columns = sorted(own.columns)
    own, twin = (x[columns].sort_values([own.columns[0], *columns]).reset_index(drop=True) for x in (own, twin))
    for c in columns:
        assert ((own[c] == twin[c]) | (own[c].isna() & twin[c].isna())).all(), c


def test_pipeline_stages(spark, corpus, tmp_path):
    docs = frame(spark, [(i, t, la, s) for i, t, la, s in corpus], extra=False)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns and {43, 44, 46}.isdisjoint(r.doc_id for r in kept.collect())
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    single = stages["near_duplicates"](spark, docs, SF)
    _, label = plain_components(rows)
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(
        {i for (i, *_), c in zip(rows, label) if i is not None and i == c})
    cut = stages["repeated_strings"](spark, docs, SF)
    assert cut.columns == docs.columns
    want = sorted((str(i), b.decode(errors="ignore")) for i, b, _ in plain_removed(rows, 50))
    assert sorted((str(float("inf") if r.doc_id is None else r.doc_id), r.text) for r in cut.collect()) == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = stages["source_mix"](spark, docs, SF)
    assert mixed.columns == docs.columns
    ids = stages["tokens"](spark, mixed, SF)
    assert ids.count() == mixed.count() and ids.where("n_tokens <> size(ids)").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


ODD = ("n_words", "kept", "removed", "__block", "row", "ids", "extra_0", "copies", "p_good", "a.b")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_leave_further_columns_alone(spark, corpus, name):
    docs = frame(spark, [(i, t, la, s) for i, t, la, s in corpus], extra=False)
    odd = docs
    for i, c in enumerate(ODD):
        odd = odd.withColumn(c, F.lit(f"mine {i}"))
    stage = dict(corpus_pipeline.STAGES)[name]
    out, plain = stage(spark, odd, SF), stage(spark, docs, SF)
    assert out.columns == odd.columns
    rows = [r.asDict() for r in out.collect()]
    assert rows and all(r[c] == f"mine {i}" for r in rows for i, c in enumerate(ODD))
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, rows)) == sorted(map(key, plain.collect()))


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and out.select("doc_id").distinct().count() <= 200
    assert re.match(r"doc_id", out.columns[0]) and out.where(F.col("n_tokens") < 0).count() == 0
