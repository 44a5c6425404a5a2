"""What must not grow with the rows: detection without shuffles, texts that stay out of the scores, sums that stay with the tasks."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import Vectors

from vocspark.operators import factor

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_language_sums_need_no_shuffle(spark):
    from vocspark.operators import language
    profiles = spark.createDataFrame([("aa", "_th", 5), ("aa", "the", 3), ("bb", "the", 7), ("bb", "_la_", 9), ("cc", "he_", 4), ("cc", "_th", 1)],
                                     "lang string, gram string, weight long")
    texts = ["the the lathe", "LA la, thé", None, "", "12 34", "zz", "the", "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    found = language.with_language(df, "text", profiles, "lang")
    assert not any(x in plan(found) for x in ("hashpartitioning", "Join", "Aggregate"))
    got = {r["id"]: r["lang"] for r in found.collect()}
    # 'the': aa 5 + 3, bb 7, cc 4 + 1; 'lathe': aa 3, bb 7, cc 4; each .la.: bb 9; 'thé': aa 5, cc 1
    assert got == {0: "bb", 1: "bb", 2: None, 3: None, 4: None, 5: None, 6: "aa", 7: "aa"}
    scores = {r["id"]: (r["detected"], r["score"]) for r in language.detect_language(df, "id", "text", profiles).collect()}
    assert scores == {0: ("bb", 21), 1: ("bb", 18), 6: ("aa", 8), 7: ("aa", 8)}
    none = language.with_language(df, "text", profiles.limit(0), "lang")
    assert [r["lang"] for r in none.collect()] == [None] * 8


def test_scored_texts_hold_no_text(spark, tmp_path):
    from vocspark.plans import registry
    from vocspark.plans import scoring as S
    docs = [(i, f"document number {i} says than and then with many plain words", "en") for i in range(9)]
    docs += [(3, "another body under the key three, with many plain words", "en"), (4, None, "en"), (None, "no key but many plain words", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(4)], "vec_id long, embedding array<double>, label int") \
        .write.parquet(f"{tmp_path}/embeddings.parquet")
    texts = registry._scored_texts(spark, str(tmp_path))
    assert not {"content", "text"} & set(texts.columns)
    bodies = S.with_contents(texts, registry._contents(spark, str(tmp_path)))
    got = sorted((r["doc_id"], r["content"] or "") for r in bodies.collect())
    scores = {k for k, t, _ in docs if t is not None}  # a key's rows meet every valid score of the key
    want = sorted((k, t or "") for k, t, _ in docs if k is not None and k in scores for _ in range(2 if k == 3 else 1))
    assert got == want
    assert bodies.select(S.TEXT_ID).distinct().count() == len(want)


def test_component_sums_stay_with_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.random((60, 700)) * (rng.random((60, 700)) < 0.1)
    rows = [(Vectors.sparse(700, [(int(j), float(r[j])) for j in np.flatnonzero(r)]),) for r in m]
    x = spark.createDataFrame(rows, ["features"]).repartition(3)
    plain = factor.fit_nmf(x, 700, 6, max_iter=6)
    fetched = []
    collected = factor.collected
    monkeypatch.setattr(factor, "SMALL", 0)
    monkeypatch.setattr(factor, "collected", lambda sums, shape, first=0: fetched.append((sums.schema["numbers"].dataType.simpleString(), shape[0])) or collected(sums, shape, first))
    large = factor.fit_nmf(x, 700, 6, max_iter=6)
    assert len(plain.errors) == len(large.errors) and np.allclose(plain.errors, large.errors, rtol=1e-4)
    assert np.allclose(plain.components, large.components, atol=1e-3)
    assert all(kind == "array<float>" or n <= 8 for kind, n in fetched)  # of a pass, 6 + 2 rows


def test_shifting_terms_sum_words_once(spark):
    from vocspark.operators.textops import shifting_terms
    rows = [("a", "2024-01", "crash crash login"), ("a", "2024-02", "crash price price"), ("a", "2024-04", "crash crash crash login price price"),
            ("a", None, "crash crash price"), (None, "2024-02", "crash price"), ("b", "2024-02", "login"), ("b", "2024-03", None)]
    df = spark.createDataFrame(rows, "c string, m string, t string").repartition(3)
    found = shifting_terms(df, "c", "m", "t")
    assert plan(found).count("sum(") == 2  # one aggregate: partial and final
    got = sorted(tuple(r) for r in found.collect())
    assert got == [("a", "2024-01", "2024-02", "price"), ("a", "2024-02", "2024-04", "crash, login")]
