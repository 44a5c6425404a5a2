"""Hand-made edge frames (FIXTURES.md §4) and brute-force checks of the non-SQL operators."""
import math

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vocspark.functions import text as T
from vocspark.functions import value as VAL
from vocspark.operators import series as S


def _ts(spark, rows):
    return spark.createDataFrame(rows, "issue_label string, month string, mentions long, severity_weighted_rate double")


def test_quality_gate_edge_texts(spark):
    texts = [None, "   ", "fourteen chars", "two words", "woooooow this is bad app", "good good good good good",
             "very good app", "The app crashes every time I open the settings page"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in df.select(T.is_valid_review(F.col("t")).alias("v")).collect()]
    assert got == [False, False, False, False, False, False, False, True]


def test_majority_word_matches_counter(spark):
    import collections
    rows = ["a a a b c", "a b a b", "x y z w v", "q q q q r r r s", "one"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r.m for r in df.select(T.has_majority_word(F.col("t")).alias("m")).collect()]
    want = [max(collections.Counter(r.lower().split()).values()) / len(r.split()) > 0.5 for r in rows]
    assert got == want


def test_severity_caps_bangs_and_punctuation(spark):
    df = spark.createDataFrame([("THIS IS A SCAM!!!!!",), ("the app crash! again",), ("it is a crash",)], "t string")
    got = [r.s for r in df.select(T.severity(F.col("t")).alias("s")).collect()]
    # 'scam!!!!!' and 'crash!' keep their punctuation, so no lexicon hit (Q13):
    # 2 + 0.5 caps + 0.6 bangs (capped) = 3.1; 2 + 0.2 = 2.2; a bare 'crash' scores 2 + 0.5
    assert got == [3.1, 2.2, 2.5]


def test_value_weight_rules(spark):
    df = spark.createDataFrame([("ENTERPRISE", "0"), ("pro", "-5"), ("premium", "abc"), ("free", "100"), (None, None)],
                               "User_Tier string, CLV string")
    got = [r.value_weight for r in VAL.value_weight(df).collect()]
    assert got == [5.0, 2.5, 4.0, round(0.8 * (1 + math.log1p(1.0)), 2), 1.0]


def test_hash_bucket_matches_python(spark):
    import hashlib
    keys = ["abc", "123", "review 1", ""]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r.b for r in df.select(VAL.hash_bucket(F.col("k")).alias("b")).collect()]
    assert got == [int(hashlib.md5(k.encode()).hexdigest(), 16) % 100 for k in keys]
    assert got[0] == 70


def test_list_literal_parse(spark):
    df = spark.createDataFrame([("['a', 'b']",), ('["it\'s"]',), ("[broken, list",), ("",)], "t string")
    got = [r.x for r in df.select(T.parse_list_literal(F.col("t")).alias("x")).collect()]
    assert got[0] == ["a", "b"] and got[1] == ["it's"] and got[2] == ["broken", "list"] and got[3] == []


def test_month_window_modes(spark):
    ts = _ts(spark, [("a", f"2024-0{m}", 1, 1.0) for m in range(1, 6)])
    def periods(n, mode):
        return {r.month: r.period for r in S.month_window(ts, n, mode).collect()}
    assert periods(2, "none") == {"2024-05": "cur", "2024-04": "cur", "2024-03": "prev", "2024-02": "prev"}
    assert periods(3, "none") == {"2024-05": "cur", "2024-04": "cur", "2024-03": "cur"}
    assert periods(3, "rest") == {"2024-05": "cur", "2024-04": "cur", "2024-03": "cur", "2024-02": "prev",
                                  "2024-01": "prev"}
    assert periods(0, "last_month") == {"2024-05": "cur", "2024-04": "prev"}


def test_anomaly_fires_but_stability_band_cannot(spark):
    rows = [("a", f"2024-{m:02d}", 10, v) for m, v in zip(range(1, 8), [1.0, 1.1, 0.9, 1.0, 1.05, 0.95, 9.0])]
    ts = _ts(spark, rows)
    an = S.anomaly_last(ts, "issue_label", "severity_weighted_rate").first()
    assert an.is_anomaly and an.n_points == 7
    b = S.stability_bands(ts.select("month", F.col("severity_weighted_rate").alias("score")))
    assert b.filter("is_volatile").count() == 0  # Q10: the window holds the point itself
    b2 = S.stability_bands(ts.select("month", F.col("severity_weighted_rate").alias("score")), exclude_current=True)
    assert b2.filter("is_volatile").count() >= 1


def test_constant_series_correlation_is_null_not_error(spark):
    long = spark.createDataFrame([("a", "m1", 1.0), ("a", "m2", 1.0), ("b", "m1", 1.0), ("b", "m2", 2.0)],
                                 "k string, month string, v double")
    assert S.correlate(long, "k", "month", "v", -2.0).count() == 0


def test_forecast_rolls_over_year(spark):
    from vocspark.plans.dashboard import trending
    rows = [(lab, f"2023-{m:02d}", 20, float(m + i)) for i, lab in enumerate(["a", "b"]) for m in range(9, 13)]
    fc = trending(_ts(spark, rows), 3).filter("is_forecast").select("month").distinct().collect()
    assert [r.month for r in fc] == ["2024-01 (Forecast)"]


def test_empty_reviews_give_zero_kpis(spark):
    from vocspark.plans.dashboard import sentiment_distribution
    from vocspark.schemas import REVIEWS
    empty = spark.createDataFrame([], REVIEWS)
    r = sentiment_distribution(empty, limit_months=3).first()
    assert (r.positive, r.negative, r.momentum) == (0, 0, 0.0)


def test_greedy_dedup_brute_force(spark):
    """near_dup_evidence vs a plain-Python greedy walk on the same candidates."""
    from vocspark.plans.registry import QUERIES
    from vocspark.sources import fixtures as FX
    got = {r.category: [int(x) for x in r.kept] for r in QUERIES["near_dup_evidence"](spark, SF_SMALL).collect()}
    vec = FX.fx_vectors(spark, SF_SMALL).collect()
    by = {}
    for r in vec:
        by.setdefault(r.category, []).append((r.vec_id, np.array(r.embedding)))
    for cat, items in by.items():
        c = np.mean([v for _, v in items], axis=0)
        c = c / np.linalg.norm(c)
        ranked = sorted(items, key=lambda t: (-float(np.dot(t[1] / np.linalg.norm(t[1]), c)), t[0]))[:20]
        kept = []
        for vid, v in ranked:
            u = v / np.linalg.norm(v)
            if len(kept) < 15 and all(float(np.dot(u, k)) < 0.85 for _, k in kept):
                kept.append((vid, u))
        assert got[cat] == [vid for vid, _ in kept]


def test_silhouette_matches_numpy(spark):
    from vocspark.plans.registry import QUERIES
    from vocspark.sources import fixtures as FX
    got = QUERIES["silhouette"](spark, SF_SMALL).first().value
    rows = FX.fx_vectors(spark, SF_SMALL).collect()
    X = np.array([r.embedding for r in rows])
    X = X / np.linalg.norm(X, axis=1, keepdims=True)
    lab = np.array([r.category for r in rows])
    D = 1 - X @ X.T
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = (D[i, own].sum() - D[i, i]) / (own.sum() - 1)
        b = min(D[i, lab == o].mean() for o in set(lab) if o != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(got - round(float(np.mean(s)), 4)) < 1e-4
