import itertools
import os
import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from rugosa.llm import common, shingles


def brute_sets(texts, k=5):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_components(ids, texts):
    sets, up = brute_sets(texts), list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            up[root(i)] = root(j)
    low = {}
    for i in range(len(ids)):
        low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return [low[root(i)] for i in range(len(ids))]


def planted(rng, copies):
    """Texts with near copies at similarities around 0.8, one large group of them, a common passage, short and empty texts."""
    ws = ["w%d" % i for i in range(500)]
    some = lambda n: [rng.choice(ws) for _ in range(n)]
    passage, texts = some(30), []
    for _ in range(60):
        base = some(rng.randint(5, 150))
        texts.append(base)
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = "x"
            texts.append(t)
    hub = some(120)
    for _ in range(copies):
        t = list(hub)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(ws)
        texts.append(t)
    texts += [some(rng.randint(1, 40)) + passage for _ in range(60)] + [some(3), [], [], ["A", "b"], ["a", "B"]]
    return [" ".join(t) for t in texts] + [None]


@pytest.mark.parametrize("small", [32, 2])
def test_stage_finds_every_pair(spark, monkeypatch, small):
    monkeypatch.setattr(shingles, "SMALL", small)
    texts = planted(random.Random(small), 60)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)] + [(None, texts[0], "x")], "doc_id long, text string, lang string")
    want = brute_components(ids, texts)
    assert len(set(want)) < len(ids) - 100
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()}
    assert got == dict(zip(ids, want))
    stay = pipeline.near_dedup_stage(spark, df, "")
    assert stay.columns == df.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in stay.collect()) == sorted({-1, *want})
    assert shingles.near_duplicates(df.limit(0)).count() == 0


def test_prefix_keeps_a_shared_shingle():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(5, 80))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.8, 1))], rng.integers(0, 1 << 62, 3).astype(np.uint64)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        known = np.sort(rng.choice(a, min(len(a), 9), replace=False))
        p, q = (shingles.prefix(x, known, np.arange(len(known)), 0.8) for x in (a, b))
        assert j < 0.8 or len(np.intersect1d(p, q))
        differing = np.bitwise_count(np.frombuffer(shingles.sketch(a), np.uint64) ^ np.frombuffer(shingles.sketch(b), np.uint64)).sum()
        assert differing <= len(np.setxor1d(a, b))


def test_pairs_meet_with_their_texts_and_not_with_whole_sets(spark, monkeypatch):
    """The tables of a run: nothing of eight bytes a shingle while pairs are confirmed, and no sets by then."""
    rng, words, were = random.Random(5), ["word%d" % i for i in range(200)], []
    texts = []
    for _ in range(60):
        t = [rng.choice(words) for _ in range(2000)]
        texts += [" ".join(t), " ".join([*t[:-10], "x"])]
    keep = common.written

    def written(df, name):
        out = keep(df, name)
        were.append((name, out._rugosa_path.removeprefix("file://")))
        if name in ("pair-texts", "pair-sets", "similar"):
            sizes = {n: sum(os.path.getsize(os.path.join(p, f)) for f in os.listdir(p)) for n, p in were if os.path.exists(p)}
            assert "shingle-sets" not in sizes
            assert max(sizes.values()) < 5 * 2000 * len(texts)
        return out

    monkeypatch.setattr(common, "written", written)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()}
    assert "similar" in dict(were)
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_recent_sets_are_made_again_when_too_many():
    import pyarrow as pa

    made = shingles.RecentSets(2, most=5)
    for _ in range(2):
        for i, t in enumerate(("a b c d", "e f g", "h i j k l m n o", "p")):
            assert made.of(i, pa.scalar(t)).tolist() == shingles.shingle_set(t, 2).tolist()


def test_passes_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(shingles, "PASS_PAIRS", 1)
    passes, keep = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: (passes.append(name), keep(df, name))[1])
    base = ["v%d" % i for i in range(150)]
    texts = [" ".join([*base[:i], "x%d" % i, *base[i + 1 :]]) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in shingles.near_duplicates(df).collect()} == {0}
    assert passes.count("similar") > 1
