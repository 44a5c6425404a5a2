"""Periodic runs, centroid clusters and the quality classifier, against brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocspark.llm import classify, kmeans, periodic, queries
from vocspark.llm.textarrays import chunks

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_length=6, min_repeats=4):
    best = {}
    for p in range(1, len(words) // min_repeats + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(min_length, min_repeats * p):
                best.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in best.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts():
    rng = random.Random(11)
    out = ["", " \n", "a", "a a a a a", "a a a a a a", "a b " * 3, "a b " * 4, "a b a b a b a b a", "x a b c a b c a b c a b c a y"]
    for _ in range(150):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        text = []
        for _ in range(rng.randint(1, 9)):
            piece = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            text += piece * rng.choice([1, 1, 3, 4, 5, 9]) + piece[: rng.randint(0, len(piece))]
        out.append("\n ".join(text))
    nested = ("é b " * 5 + "c ") * 6
    return out + [nested, nested + "d " + nested, "k " * 3000 + "l k " * 300, " ".join(f"w{i % 700}" for i in range(3100))]


@pytest.mark.parametrize("rounds", [periodic.ROUNDS, 1, 0])
def test_runs_equal_brute_force(rounds):
    texts = run_texts()
    seen = 0
    for at, x in chunks(pa.array(texts), 20_000):
        _, _, before, runs = periodic.runs_of(x, rounds=max(rounds, 1))
        if rounds == 0:  # no splitting at all
            begin, end, _ = x.words()
            runs = periodic.scan(x.piece_hashes(x.prefix_sums(), begin, end), before[:-1], before[1:], 6, 4)
        for d in range(x.n):
            own = runs[(runs[:, 0] >= before[d]) & (runs[:, 0] < before[d + 1])] - [before[d], 0, 0]
            assert [tuple(r) for r in own.tolist()] == plain_runs(WORD.findall(texts[at + d])), texts[at + d][:80]
            seen += 1
    assert seen == len(texts)


@pytest.mark.parametrize("least,repeats", [(3, 3), (6, 4), (10, 5)])
def test_runs_of_rows(spark, least, repeats):
    rows = [(i, t, "en", "s") for i, t in enumerate(run_texts()[:60])] + [(None, None, None, None), (3, "a a a a a a", "en", "s")]
    docs = frame(spark, rows).withColumn("n_words", F.lit(-7)).withColumn("runs", F.lit("mine")).withColumn("a.b", F.lit(1))
    got = periodic.with_runs(docs, min_length=least, min_repeats=repeats)
    assert got.columns == [c for c in docs.columns if c not in periodic.RESULTS] + ["n_words", "runs", "collapsed"]
    want = []
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        runs = plain_runs(words, least, repeats)
        want.append((str(i), len(words), [tuple(r) for r in runs], plain_collapsed(words, runs)))
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()) == sorted(want)
    assert periodic.with_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.with_runs(docs, min_repeats=2)


def test_long_periodic_text_takes_little_time():
    words = ["a"] * 200_000 + [f"w{i % 30_000}" for i in range(200_000)]
    (_, x), = chunks(pa.array([" ".join(words)]))
    _, _, _, runs = periodic.runs_of(x)
    assert [tuple(r) for r in runs.tolist()] == [(0, 200_000, 1), (200_000, 200_000, 30_000)]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_planted_tails_and_digests(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 90))), "en", "s") for i in range(150)]
    rows += [(None, "a b c", None, None), (20, None, None, None), (rows[3][0], "z z z z z z z", "en", "s")]
    docs = frame(spark, rows).withColumn("words", F.lit(1)).withColumn("row", F.lit(2))
    assert periodic.with_planted_tail(docs).columns == docs.columns
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t, *_ in rows:
        words = planted(i, WORD.findall(t or ""))
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want.append((str(i), len(runs), *map(str, best), str(runs and 1000 * best[1] // best[2] or None),
                     hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
                     hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()))
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_runs, str(r.start), str(r.length), str(r.period), str(r.exponent_milli), r.runs_sha256,
                   r.collapsed_sha256) for r in got) == sorted(want)
    assert any(w[1] for w in want)


def plain_nearest(x, centroids):
    d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
    return d.index(min(d)), min(d)


def test_threshold_search_equals_brute_force():
    rng = np.random.default_rng(2)
    for t in range(30):
        dims, k = int(rng.integers(1, 9)), int(rng.integers(1, 20))
        centroids = rng.integers(-3, 4, (k, dims)) * int(rng.choice([1, 100]))
        x = np.concatenate([rng.integers(-5, 6, (50, dims)) * int(rng.choice([1, 90])), centroids])
        number, distance = kmeans.SortedLists.of(centroids).nearest(x)
        assert [(int(c), int(d)) for c, d in zip(number, distance)] == [plain_nearest(v, centroids.tolist()) for v in x.tolist()]


def test_threshold_search_reads_few_of_many_centroids():
    """It stops early: with well separated centroids most are never met."""
    rng = np.random.default_rng(3)
    centroids = np.arange(400)[:, None] * 1000 + rng.integers(0, 9, (400, 3))
    lists = kmeans.SortedLists.of(centroids)
    met = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, (int, np.integer)):
                met.append(key)
            return super().__getitem__(key)

    number, _ = kmeans.SortedLists(centroids.view(Counted), lists.values, lists.owners).nearest(centroids[:1] + 1)
    assert number[0] == 0 and len(met) < 10


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=4).round(2)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0, 9.0]), (None, [0.5, 0.5, 0.5, -0.5]), (200, None), (201, [1.0]), (202, [1.0, None, 1.0, 1.0]),
             (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1e300, 0.0, 0.0, 0.0]), (206, [0.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("__v", F.lit(0))
    kept = [(i, tuple(math.floor(64 * c) for c in v)) for i, v in rows
            if v and len(v) == 4 and all(c is not None and math.isfinite(c) and abs(c) < 1e6 for c in v)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((name(i), v) for i, v in kept)[:16]]
    for _ in range(3):
        own = [plain_nearest(v, centroids)[0] for _, v in kept]
        centroids = [tuple(sum(x) // own.count(c) for x in zip(*[v for (_, v), o in zip(kept, own) if o == c])) if c in own else centroids[c]
                     for c in range(len(centroids))]
    placed = [(i, *plain_nearest(v, centroids)) for i, v in kept]
    want = sorted((str(i), c, d, sum(y for _, x, y in placed if x == c), sum(y for *_, y in placed),
                   hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in placed)
    got = kmeans.cluster(table.repartition(3), dims=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    for few in (table.limit(0), table.where("vec_id = 200"), table.where("vec_id in (1, 2)")):
        out = kmeans.cluster(few, dims=4)
        assert out.dtypes == got.dtypes and out.count() == few.where("vec_id < 200").count()


def test_ftrl_steps_equal_the_formula():
    """One coordinate at a time, as the update is written down."""
    rng = np.random.default_rng(6)
    state = classify.Ftrl(np.zeros(5), np.zeros(5))
    z, n = [0.0] * 5, [0.0] * 5
    for _ in range(80):
        place = np.sort(rng.choice(5, 3, replace=False))
        value, label = rng.normal(size=3), float(rng.integers(0, 2))
        w = {}
        for i in place:
            w[i] = 0.0 if abs(z[i]) <= state.l1 else -(z[i] - math.copysign(state.l1, z[i])) / ((state.beta + math.sqrt(n[i])) / state.alpha + state.l2)
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(place, value))))
        for i, v in zip(place, value):
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / state.alpha * w[i]
            n[i] += g * g
        state.learn(place, value, label)
    assert np.allclose(state.z, z) and np.allclose(state.n, n)


def test_features_are_unit_counts():
    texts = ["a b a b c", "", " \n", "A", "über über !!"]
    (_, x), = chunks(pa.array(texts))
    bounds, place, value = classify.features(x)
    assert np.diff(bounds)[1:3].tolist() == [0, 0] and (place > 0).all()
    for i in (0, 3, 4):
        assert np.isclose((value[bounds[i]:bounds[i + 1]] ** 2).sum(), 1)
    alone = classify.features(next(chunks(pa.array([texts[4]])))[1])
    assert alone[1].tolist() == place[bounds[4]:bounds[5]].tolist()


def test_classifier_learns_and_takes_odd_rows(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "by", "old", "mill", "and", "bank"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW!!", "WIN", "CASH!!"]) for _ in range(40))
    rows = [(i, good() if i % 2 else bad(), "en", "s") for i in range(200)]
    long = good() * 400
    rows += [(900, None, None, None), (901, "", None, None), (902, "  ", None, None), (None, good(), None, None), (3, bad(), "en", "s"),
             (903, long, "en", "s"), (903, long, "en", "s")]
    docs = frame(spark, rows).withColumn("predicted", F.lit("mine")).withColumn("the text", F.lit(1))
    marks = [(i, i % 2) for i in range(0, 100)] + [(5, 1), (6, None), (7, 3), (None, 1), (950, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, label int")
    weights = classify.train(classify.sample(docs, labels))
    again = classify.train(classify.sample(docs.repartition(7), labels.repartition(2)))
    assert (weights == again).all()
    got = classify.score(docs, weights)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    scores = [(r.doc_id, r.score) for r in got.collect()]
    for i, s in scores:
        assert 0 <= s <= 1
        if i in range(100, 200):
            assert (s > 0.5) == bool(i % 2)
    empties = {s for i, s in scores if i in (900, 901, 902)}
    assert len(empties) == 1 and len({s for i, s in scores if i == 903}) == 1
    assert classify.score(docs.limit(0), weights).count() == 0
    none = classify.train(classify.sample(docs, labels.limit(0)))
    assert not none.any() and {r.score for r in classify.score(docs, none).collect()} == {0.5}
    assert classify.sample(docs, labels, size=20).count() < 50


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rows = [(r.quality, r.score, r.predicted) for r in got.collect()]
    good, bad = ([s for q, s, _ in rows if q == k] for k in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    right = sum(q == p for q, _, p in rows) / len(rows)
    print("held out:", len(rows), "AUC", round(auc, 4), "accuracy", round(right, 4))
    assert auc > 0.95 and right > 0.9
