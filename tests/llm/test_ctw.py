import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rugosa.llm import ctw


def kt(n0, n1):
    p = 1.0
    for i in range(n0):
        p *= (i + 0.5) / (i + 1)
    for i in range(n1):
        p *= (i + 0.5) / (n0 + i + 1)
    return p


class Brute:
    """The same tree, recursively: nodes by (context, bits so far)."""

    def __init__(self, seqs, depth):
        self.depth, self.n = depth, Counter()
        self.children = {}
        for s in seqs:
            s = bytes(depth) + s
            for i in range(depth, len(s)):
                bits = format(s[i], "08b")
                for j in range(8):
                    for d in range(depth + 1):
                        ctx = s[i - d : i]
                        self.n[ctx, bits[:j], bits[j]] += 1
                        if d < depth:
                            self.children.setdefault((ctx, bits[:j]), set()).add(s[i - d - 1 : i])

    def counts(self, ctx, part):
        return self.n[ctx, part, "0"], self.n[ctx, part, "1"]

    def lw(self, ctx, part):
        own = math.log(kt(*self.counts(ctx, part)))
        if len(ctx) == self.depth:
            return own
        below = sum(self.lw(c, part) for c in self.children.get((ctx, part), ()))
        return np.logaddexp(own, below) - math.log(2)

    def p(self, ctx, d, part, bit):
        c = ctx[len(ctx) - d :]
        n0, n1 = self.counts(c, part)
        own = ((n1 if bit == "1" else n0) + 0.5) / (n0 + n1 + 1)
        if d == self.depth or n0 + n1 == 0:
            return own
        longer = ctx[len(ctx) - d - 1 :]
        if sum(self.counts(longer, part)) == 0:
            return own
        odds = math.exp(math.log(kt(n0, n1)) - sum(self.lw(x, part) for x in self.children[c, part]))
        return (odds * own + self.p(ctx, d + 1, part, bit)) / (odds + 1)

    def score(self, s):
        s, out = bytes(self.depth) + s, 0.0
        for i in range(self.depth, len(s)):
            bits = format(s[i], "08b")
            out += sum(math.log10(self.p(s[i - self.depth : i], 0, bits[:j], bits[j])) for j in range(8))
        return out


def canon(t):
    return b" ".join((t or "").encode().lower().split()) + b"\xff"


@pytest.mark.parametrize("entries,hot", [(10**6, 1000), (60, 3)])
def test_scores(spark, entries, hot):
    rng = random.Random(4)
    ws = ["the", "then", "Ab", "abc", "é", "x.", "zz"]
    rows = [(i, " ".join(rng.choice(ws) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(41, None), (42, "  only\tOnce \n here"), (42, "only once here"), (None, "the")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, word string, row_key int")
    got = sorted(ctw.score_documents(df, depth=3, hot_words=hot, max_entries=entries).collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens))
    held = [zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1 for i, _ in rows]
    train = [t for (_, t), h in zip(rows, held) if not h]
    tree = Brute([canon(t) for t in train], 3)
    words = Counter(w for t in train for w in [*(t or "").lower().split(), None])
    n, v = sum(words.values()), len(words)
    want = []
    for (i, t), h in zip(rows, held):
        w = [*(t or "").lower().split(), None]
        want.append((-1 if i is None else i, len(w), h, sum(words[x] > 0 for x in w), n, sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), tree.score(canon(t))))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=lambda r: r[:2])):
        assert ((-1 if g.doc_id is None else g.doc_id), g.n_tokens, g.held_out, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        assert g.score == pytest.approx(w[6], rel=1e-5)


def test_sums_to_one(spark):
    """After any context the 256 bytes' probabilities sum to one, seen or not."""
    codes, counts = [], []
    rng = random.Random(1)
    seqs = [bytes(rng.choice(b"abc") for _ in range(50)) for _ in range(3)]
    k, _ = ctw.grams_of([[s] for s in seqs], 2)
    u, n = np.unique(k, return_counts=True)
    ctx = int(u[5]) >> 8
    every = np.array([ctx << 8 | x for x in range(256)], np.uint64)
    codes = np.union1d(u, every)
    counts = np.zeros(len(codes))
    counts[np.searchsorted(codes, u)] = n
    rows = {}
    for s in np.unique(codes >> np.uint64(8)):
        at = (codes >> np.uint64(8)) == s
        for nodes, _, lw in ctw.weighed(codes[at], counts[at], 2, 2):
            for i, a, b, w in zip(nodes[0].ids & np.uint64(0xFFFF), nodes[0].n0, nodes[0].n1, lw):
                r = rows.setdefault(int(i), [0.0, 0.0, 0.0])
                r[0] += a
                r[1] += b
                r[2] += w
    upper = ctw.Upper([(i, *r) for i, r in rows.items()])
    at = (codes >> np.uint64(8)) == ctx
    got = ctw.code_lengths(codes[at], counts[at], upper, 2)
    assert (10**got).sum() == pytest.approx(1)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score_documents(df).count() == 0


def test_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = ctw.score_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].base_score is None and r[0].score == pytest.approx(24 * math.log10(0.5))


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10, 1e6, 1e12])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
