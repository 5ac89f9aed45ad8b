import itertools
import random

import numpy as np
import pytest
import xxhash

from rugosa.llm import common, simhash


def brute_fingerprint(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [x for x in "".join(c if c not in " \t\n\v\f\r" else " " for c in w).split(" ") if x]
    if not words:
        return 0
    sh = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, budget=3):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= budget:
            up[root(i)] = root(j)
    low = {}
    for i in range(len(ids)):
        low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return [low[root(i)] for i in range(len(ids))]


def test_fingerprint():
    rng = random.Random(1)
    for t in [None, "", " \n", "One", "one TWO", "É é \x85 a b", "a b c a b c a b c", " ".join(rng.choice("abcdefg") for _ in range(2000))]:
        assert simhash.fingerprint(t) % 2**64 == brute_fingerprint(t)


@pytest.mark.parametrize("budget", [0, 1, 3, 5])
@pytest.mark.parametrize("dense", [False, True])
def test_tries(budget, dense):
    rng = np.random.default_rng(budget)
    x = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 8))}) for _ in range(900)], np.uint64)
    x = np.unique(x[rng.integers(0, 2 if dense else 60, 900)] ^ flips)
    a, b = simhash.joined_tries(x, None, budget)
    lab = common.groups_of(np.arange(len(x)), a, b)
    want = brute_components(list(range(len(x))), [int(v) for v in x], budget)
    assert lab.tolist() == want
    y, x = x[1::2], x[::2]
    a, b = simhash.joined_tries(x, y, budget)
    both = np.concatenate([x, y])
    assert all((int(both[i]) ^ int(both[j])).bit_count() >= 0 for i, j in zip(a, b))
    lab = common.groups_of(np.arange(len(both)), a, b)
    up = common.groups_of(np.arange(len(both)), *np.array([(i, len(x) + j) for i in range(len(x)) for j in range(len(y)) if (int(x[i]) ^ int(y[j])).bit_count() <= budget] or np.empty((0, 2), int), int).T)
    assert lab.tolist() == up.tolist()


def test_query(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["w%d" % i for i in range(400)]) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    rows = [(i, rng.choice(base) if rng.random() < 0.5 else base[i % 150] + " more") for i in range(700)]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " ", "x", "X", base[3], "y " * 30_000])] + [(None, "a b c"), (5, base[3]), (5, "quite another text of many words here")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect())
    known = [r for r in rows if r[0] is not None]
    fps = [brute_fingerprint(t) for _, t in known]
    want = sorted([(i, f, c) for (i, _), f, c in zip(known, fps, brute_components([i for i, _ in known], fps))] + [(-1, brute_fingerprint("a b c"), None)])
    assert got == want
    stay = simhash.drop_near_duplicates(df, 3, 3)
    assert stay.columns == df.columns
    ids = [r.doc_id for r in stay.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for _, _, c in want}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_many_nodes(spark):
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64))
    y = np.unique(np.concatenate([x, x[::3] ^ 5, x[::5] ^ (1 << 60)]))
    df = spark.createDataFrame([(int(v),) for v in y], "fp long")
    got = {(r.node, r.component) for r in common.components(simhash.near_links(df, 3, most=64)).collect()}
    comp = brute_components(y.tolist(), [int(v) % 2**64 for v in y])
    from collections import Counter

    many = Counter(comp)
    assert got == {(v, c) for v, c in zip(y.tolist(), comp) if many[c] > 1}


def test_components(spark):
    rng = random.Random(2)
    e = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1400)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(e, "a long, b long")).collect()}
    ids = sorted({x for p in e if p[0] != p[1] for x in p})
    up = common.groups_of(np.arange(3000), np.array([a for a, _ in e]), np.array([b for _, b in e]))
    assert got == {i: int(up[i]) for i in ids}
