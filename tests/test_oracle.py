"""Every registered query against its DuckDB oracle on sf0.001 (row count, columns, values)."""
import pytest

from tools.compare import digest
from vocspark import config as C

import __spark_entry__ as E
from tests.conftest import SF_SMALL

SQL = E.oracle_sql()
#: Queries of the training-data subpackage have tests of their own.
KEYS = sorted(k for k in E.queries() if k != "pipeline" and not k.startswith("op"))

#: No SQL twin: model fits and what is made from them. Each names a check of its result.
NO_ORACLE = {
    "sentiment_model": lambda r: {x.label: x.f1 for x in r}["accuracy"] > 0.6,
    "topic_model": lambda r: len({x.topic_id for x in r}) > 1 and all(x.topic_keywords for x in r),
    "topic_fit": lambda r: all(a.error >= b.error for a, b in zip(r, r[1:])) and r[-1].error < 0.98 * r[0].error,
    "topic_labels": lambda r: len(r) == 30 and {x.label for x in r} <= set(C.ALL_LABELS) and all(len(x.keywords.split(", ")) == 5 for x in r),
    "encode_text": lambda r: len(r) == 200 and all(abs(sum(v * v for v in x.embedding) - 1) < 1e-9 for x in r if any(x.embedding)),
    "taxonomy_centroids": lambda r: {x.category for x in r} == set(C.TAXONOMY_LABELS) and all(
        abs(sum(v * v for v in x.centroid) - 1) < 1e-9 for x in r),
    "semantic_classify_text": lambda r: all(x.predicted == (x.best_label if x.confidence >= 0.3 else C.FALLBACK_LABEL)
                                            for x in r if abs(x.confidence - 0.3) > 1e-4),
    "text_centroid_metrics": lambda r: {x.label: x.f1 for x in r}["accuracy"] > 0.9,
    "emerging_clusters": lambda r: r and all(x.estimated_volume >= 20 and x.label in C.ALL_LABELS and x.sample_review_1
                                             and x.is_flagged for x in r),
    "emerging_watchlist": lambda r: 0 < len(r) <= 6,
    "emerging_issues": lambda r: r and [x.estimated_volume for x in sorted(r, key=lambda x: x.rank)] == sorted(
        (x.estimated_volume for x in r), reverse=True) and all(20 <= x.estimated_volume <= 200 for x in r),
    "score_batch_emerging": lambda r: r and all(x.estimated_volume >= 20 and x.label in C.ALL_LABELS for x in r),
    "ingest_sync_log": lambda r: [x.run for x in r] and len({x.run for x in r}) == len(r) and {x.status for x in r} == {"success"},
    "detect_issues": lambda r: [x["rank"] for x in r] == list(range(1, len(r) + 1)) and
    [x.mentions for x in r] == sorted((x.mentions for x in r), reverse=True) and sum(x.mentions for x in r) <= 1500,
    "top_issues_from_reviews": lambda r: all(0 < x.pct <= 100 for x in r) and sum(x.pct for x in r) < 101,
}


def test_every_query_has_an_oracle_or_a_stated_check():
    assert {k for k in KEYS if k not in SQL} == set(NO_ORACLE)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    rows = df.collect()
    if key not in SQL:
        assert NO_ORACLE[key](rows), rows[:5]
        return
    rows = [tuple(r) for r in rows]
    cur = duck.execute(SQL[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    hs, ls = digest(df.columns, rows)
    hd, ld = digest(dcols, drows)
    assert hs == hd, (sorted(set(ls) - set(ld))[:3], sorted(set(ld) - set(ls))[:3])


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "issue" in df.columns
