"""Operators that compare or count across documents, against brute force."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocspark.llm import ann, mixing, ngramjoin, sharding, suffixdedup
from vocspark.llm.components import components

from .conftest import SCHEMA, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_removed(rows, length):
    """(id, kept bytes) of each row."""
    owner = {}
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        for p in range(len(b) - length + 1):
            w = b[p: p + length]
            owner[w] = min(owner.get(w, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if owner[b[p: p + length]] < i:
                gone[p: p + length] = b"\1" * length
        out.append((i, bytes(c for c, g in zip(b, gone) if not g), gone))
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_repeats_are_removed(spark, corpus, hot):
    got = suffixdedup.remove_repeats(frame(spark, corpus), "doc_id", "text", hot=hot, block_bytes=40_000).collect()
    want = plain_removed(corpus, 50)
    key = lambda x: (x[0], x[1])
    have = sorted([(float("inf") if r.doc_id is None else r.doc_id, bytes(r.kept)) for r in got], key=key)
    assert have == sorted([x[:2] for x in want], key=key)
    for r in got:
        spans, size = [(s.start, s.end) for s in r.removed], len((r.text or "").encode())
        assert all(a < b <= size for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        assert size - sum(b - a for a, b in spans) == len(r.kept)
    assert suffixdedup.remove_repeats(frame(spark, corpus).limit(0)).count() == 0


def test_kept_text_has_whole_characters(spark):
    shared = "é" * 40
    docs = frame(spark, [(1, "a" + shared, "fr", "s"), (2, "bb" + shared[:30] + "ñ", "fr", "s")])
    for r in suffixdedup.remove_repeats(docs, "doc_id", "text", as_text=True).collect():
        assert r.kept == {1: r.text, 2: "bb"}[r.doc_id]  # the cut takes the first byte of ñ


@pytest.mark.parametrize("length", [3, 7, 20])
def test_suffix_order(length):
    rng = np.random.default_rng(length)
    for _ in range(60):
        data = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(length, 150)).astype(np.uint8)
        order, begin = suffixdedup.prefix_classes(data, np.arange(len(data) - length + 1), length)
        pieces = [bytes(data[i: i + length]) for i in order]
        assert pieces == sorted(pieces)
        assert [pieces[b] for b in begin] == sorted(set(pieces))


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i: i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    label = [i for i, *_ in rows]
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if sets[a] and sets[b] and label[a] is not None and label[b] is not None
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return [len(s) for s in sets], label


@pytest.mark.parametrize("part", [4000, 2])
def test_ngram_join(spark, corpus, part):
    got = ngramjoin.components_of(frame(spark, corpus), block_bytes=40_000, part=part, task_tokens=500).collect()
    sizes, label = plain_components(corpus)
    none = lambda x: -1 if x is None else x
    assert (sorted((none(r.doc_id), r.n_shingles, none(r.component_id)) for r in got)
            == sorted((none(i), n, none(c)) for (i, *_), n, c in zip(corpus, sizes, label)))


def test_one_document_of_each_group_stays(spark, corpus):
    rows = corpus + [corpus[0]]
    docs = frame(spark, rows)
    out = ngramjoin.one_of_each(docs, block_bytes=40_000)
    assert out.columns == docs.columns
    _, label = plain_components(rows)
    want = {i for (i, *_), c in zip(rows, label) if i is not None and i == c}
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(want)
    assert ngramjoin.one_of_each(docs.limit(0)).count() == 0


def test_prefix_tree_join_finds_all_links():
    rng = np.random.default_rng(3)
    for t in range(60):
        base = [rng.choice(500, rng.integers(1, 30), replace=False) for _ in range(3)]
        sets = {tuple(sorted(set(base[rng.integers(3)]) ^ set(rng.choice(500, rng.integers(0, 3))))) for _ in range(12)}
        sets = [np.array(s) for s in sets if s]
        label = ngramjoin.linked_groups(sets, np.zeros(len(sets), dtype=int))
        want = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if 100 * len(x & y) >= 80 * len(x | y):
                    p, q = want[a], want[b]
                    want = [min(p, q) if v in (p, q) else v for v in want]
        index = lambda v: [list(v).index(x) for x in v]
        assert index(label) == index(want)


def chained_sets(rng, n):
    """n sets of 40 shingles, of which each shares its smallest with the next one's; the last two are near copies."""
    own = np.sort(rng.choice(1 << 40, (n, 40), replace=False) + 1000)
    for i in range(n):
        own[i, :2] = i, i + 1
    near = own[-1].copy()
    near[-1] += 1
    return [*own, near]


def test_sets_that_share_little_need_no_probe(monkeypatch):
    """Sets which a chain of single shingles joins are told apart by the counts of their prefixes."""
    probes, probe = [], ngramjoin.PrefixTree.probe
    monkeypatch.setattr(ngramjoin.PrefixTree, "probe", lambda self, *a: probes.append(len(self.end_set)) or probe(self, *a))
    sets = chained_sets(np.random.default_rng(5), 60)
    label = ngramjoin.linked_groups(sets, np.zeros(len(sets), dtype=int))
    assert label.tolist() == [*range(60), 59]
    assert probes == [2]  # of the near copies alone
    side = np.arange(len(sets)) % 2
    assert ngramjoin.linked_groups(sets, side).tolist() == [*range(60), 59]


def test_prefix_counts_keep_all_links():
    rng = np.random.default_rng(6)
    met = 0
    for t in range(40):
        base = rng.choice(np.iinfo(np.int64).max, 90)
        sets = []
        for _ in range(20):
            own = set(base[: rng.integers(60, 90)].tolist())
            own -= set(rng.choice(base, rng.integers(0, 12)).tolist())
            own |= set(rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 8)).tolist())
            sets.append(np.sort(np.array(sorted(own)).view(np.uint64)).view(np.int64))
        side = rng.integers(0, 2, len(sets)) if t % 2 else np.zeros(len(sets), dtype=int)
        two = bool(side.any() and not side.all())
        size = np.array([len(s) for s in sets])
        cut = [s[:n] for s, n in zip(sets, ngramjoin._prefix_size(size, 80))]
        p = ngramjoin.Prefixes(cut, size, side, two, 80)
        for a in range(len(sets)):
            for b in range(len(sets)) if two and not side[a] else range(a + 1, len(sets)) if not two else ():
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if (not two or side[b]) and 100 * len(x & y) >= 80 * len(x | y):
                    met += 1
                    assert b in p.may_link(a)
    assert met > 500


def test_wide_groups_are_split_before_the_join(spark, monkeypatch):
    """A group of more than `part` sets that single shingles join goes to the join as what the counts leave together."""
    dealt, deal = [], ngramjoin._dealt
    monkeypatch.setattr(ngramjoin, "_dealt", lambda sets, groups, part: dealt.append(groups) or deal(sets, groups, part))
    sets = chained_sets(np.random.default_rng(7), 12)
    rows = [(i, len(s), s.tolist(), s[:12].tolist()) for i, s in enumerate(sets)]
    reps = spark.createDataFrame(rows, "rep long, n_shingles long, tokens array<long>, names array<long>")
    edges = ngramjoin._edges(reps, 80, 4, 10_000).collect()
    assert [(e.a, e.b) for e in edges] == [(12, 11)]
    assert [g.count() for g in dealt] == [13, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards(spark, corpus):
    docs = frame(spark, [(i, f"t{i}", "en", "s") for i in range(4000)] + corpus)
    out = sharding.shard_documents(docs).collect()
    assert len(out) == 4000 + len(corpus)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    assert 40 < sum(r.grown_shard == 40 for r in out) < 200
    text = {i: t for i, t, *_ in corpus}
    for r in out:
        if r.doc_id in (40, 41, 46, 50):
            b = (text[r.doc_id] or "").encode()
            if r.size == len(b) + 16:
                assert r.text_crc32 == zlib.crc32(b)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_weight_changes_stay_in_their_subtree(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"))
    before, after = sharding.topology(20), sharding.topology(20, {3: 3.0})
    both = sharding.descend(sharding.descend(rows, "doc_id", before, "a"), "doc_id", after, "b").collect()
    moved = [r for r in both if r.a != r.b]
    assert moved and all(r.b // 10 == 0 for r in moved)  # into the region of the heavier shard only
    assert {r.b for r in moved if r.a // 5 == 0} == {3}  # within its rack only to the shard itself


def test_mix(spark, corpus):
    docs = frame(spark, corpus)
    out = mixing.with_copies(docs).collect()
    assert len(out) == len(corpus)
    size = {}
    for _, t, _, s in corpus:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, budget = {}, set(names), float(sum(size.values()))
    while True:
        level = budget / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            budget -= target[s]
            free.remove(s)
    target |= {s: weight[s] * level for s in free}
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        if r.source_size:
            assert abs(r.copies - r.target / r.source_size) < 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 5}") for i in range(6000)]
    out = mixing.with_copies(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA))
    for r in out.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect():
        assert abs(r.taken / r.target - 1) < 0.1


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(8, 16))
    v = centers[rng.integers(8, size=700)] + 0.5 * rng.normal(size=(700, 16))
    v[300:500] = v[300]  # a vector that many rows repeat
    rows = [(i, [float(x) for x in row], 1) for i, row in enumerate(v)]
    bad = [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [1.0] * 15 + [None], 1), (1060, [1.0] * 15 + [float("nan")], 1),
           (1080, [1.0] * 3, 1), (None, [1.0] * 16, 1), (1100, [float("inf")] * 16, 1)]
    return v, spark.createDataFrame(rows + bad + rows[40:42], "vec_id long, embedding array<double>, rank int")


def test_nearest_vectors(spark, vectors):
    v, df = vectors
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        scores = (v * v[q]).sum(axis=1)
        want = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:20]
        assert [x[0] for x in found] == list(range(1, 21))
        assert [(-x[2], x[1]) for x in found] == sorted((-x[2], x[1]) for x in found)
        assert all(x[2] == pytest.approx(scores[x[1]], rel=1e-12) for x in found)
        hits += len({x[1] for x in found} & {i for _, i in want})
    assert hits >= 0.9 * 20 * len(got)


def test_few_vectors_find_each_other(spark, vectors):
    _, df = vectors
    few = df.where("vec_id < 6 or vec_id >= 1000")
    out = ann.search(few, F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in out) == [1, 2, 3, 4, 5]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("bucket", [8192, 50])
def test_an_id_on_many_rows_takes_one_place(spark, monkeypatch, bucket):
    monkeypatch.setattr(ann, "BUCKET_ROWS", bucket)
    rng = np.random.default_rng(3)
    center = rng.normal(size=16)
    v = center + 0.05 * rng.normal(size=(100, 16))
    many = 1.1 * center + 0.001 * rng.normal(size=(1000, 16))  # near the top for every query
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(777, [float(x) for x in row]) for row in many]
    rows += [(778, [float(x) for x in 1.1 * center])] * 1000
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 100, 20))
    for q, found in got.items():
        best = {i: s for i, s in enumerate((v * v[q]).sum(axis=1)) if i != q}
        best |= {777: (many @ v[q]).max(), 778: 1.1 * center @ v[q]}
        want = sorted((-s, i) for i, s in best.items())[:20]
        assert [x[1] for x in sorted(found)] == [i for _, i in want]
        assert [x[2] for x in sorted(found)] == pytest.approx([-s for s, _ in want])


def test_sparse_regions_find_their_neighbours(spark):
    rng = np.random.default_rng(8)
    tight = np.repeat(rng.normal(size=(4, 16)), 300, axis=0) + 0.1 * rng.normal(size=(1200, 16))
    v = np.concatenate([tight, rng.normal(size=16) + 0.25 * rng.normal(size=(800, 16))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = {}
    for q, found in got.items():
        scores = (v * v[q]).sum(axis=1)
        want = {i for _, i in sorted((-s, i) for i, s in enumerate(scores) if i != q)[:20]}
        hits.setdefault("tight" if q < 1200 else "sparse", []).append(len(found & want) / 20)
    assert {k: len(x) for k, x in hits.items()} == {"tight": 60, "sparse": 40}
    assert all(np.mean(x) >= 0.95 for x in hits.values()), {k: np.mean(x) for k, x in hits.items()}
