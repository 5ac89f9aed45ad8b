"""Quality rules, source divergences and importance resampling, against plain versions of their definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rugosa.llm import bytewords, common, crc, divergence, importance, quality

ODD = ["", None, " ", "\n\n", "Ab c1É é漢 \x00x\t" + "q" * 40 + " " + "q" * 41 + " " + "q" * 40, " lead", "tail", "x" * 5000, "a b c a b c", "l\nl\n l\nl", "the cat " * 3000, "\n", "#*$%&|<> A! b? C.", "İstanbul ſ K"]
PATTERNS = [(bytewords.NO_SPACE, r"[^\x20\x09-\x0D]+"), (bytewords.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (bytewords.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def texts(n, seed=0):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice("abcA é漢\n\t9$|") for _ in range(rng.randint(0, 300))) for _ in range(n)]


@pytest.mark.parametrize(("is_word", "pattern"), PATTERNS)
def test_words_hashes_and_groups(is_word, pattern):
    ts = texts(300)
    w = bytewords.ByteWords(pa.array(ts), is_word)
    want = [x.encode() for t in ts for x in re.findall(pattern, low(t))]
    assert w.slices(np.arange(len(w))) == want
    assert w.counts().tolist() == [len(re.findall(pattern, low(t))) for t in ts]
    assert bytewords.xxh64(w.buf, w.starts, w.lengths, 42).tolist() == [xxhash.xxh64_intdigest(x, 42) for x in want]
    for h in (None, (w.lengths % 3).astype(np.uint64), np.zeros(len(w), np.uint64)):  # hashes that collide are told apart
        ids, examples = bytewords.grouped(w.buf, w.starts, w.lengths, h)
        assert len(set(want)) == len(examples) == ids.max() + 1
        assert all(want[e] == x for x, e in zip(want, examples[ids].tolist(), strict=True))
    none = bytewords.ByteWords(pa.array([], pa.string()), is_word)
    assert len(none) == 0 and bytewords.grouped(none.buf, none.starts, none.lengths)[0].tolist() == []


def test_sliced_batches():
    ts = texts(20)
    w = bytewords.ByteWords(pa.array(ts).slice(3, 9), bytewords.NO_SPACE, fold=False)
    assert w.slices(np.arange(len(w))) == [x.encode() for t in ts[3:12] for x in re.findall(PATTERNS[0][1], t or "")]


def test_crc_algebra():
    ts = texts(300, 1)
    w = bytewords.ByteWords(pa.array(ts), bytewords.ALNUM)
    words = w.slices(np.arange(len(w)))
    sums = crc.of_slices(w.buf, w.starts, w.lengths, block=100)
    assert sums.tolist() == [zlib.crc32(x) for x in words]
    found, of = crc.of_runs(sums, w.lengths, w.texts_of(), 1, 4)
    want = collections.Counter()
    for i, t in enumerate(ts):
        each = [x.encode() for x in re.findall(PATTERNS[2][1], low(t))]
        want.update((i, zlib.crc32(b" ".join(each[j : j + k]))) for k in range(1, 5) for j in range(len(each) - k + 1))
    assert collections.Counter(zip(of.tolist(), found.tolist(), strict=True)) == want
    a, b = b"x" * 1000, b"y" * 123_456
    assert crc.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))[0] == zlib.crc32(a + b)


def resampled(rows, target, least, most, percent, min_words):
    bucket = lambda t: [zlib.crc32(" ".join(w[j : j + k]).encode()) % 50 for w in [re.findall(PATTERNS[2][1], low(t))] for k in range(least, most + 1) for j in range(len(w) - k + 1)]
    s, t = collections.Counter(b for _, x in rows for b in bucket(x)), collections.Counter(b for x in target for b in bucket(x))
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        f, h = bucket(x), int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + 50) / ((s[b] + 1) * (tt + 50)))) for b in f)
        out.append((i, len(re.findall(PATTERNS[2][1], low(x))), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    return out, [r[0] for r in order[: percent * len(order) // 100]]


@pytest.mark.parametrize(("least", "most"), [(1, 1), (1, 3), (2, 2)])
def test_importance(spark, least, most):
    ts = texts(120, 2)
    rows = [(i, t) for i, t in enumerate(ts)] + [(7, ts[40]), (7, ts[40]), (None, ts[50]), (None, None)]
    target = texts(10, 3)
    docs = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, part int, rank int, n_words string")
    got = importance.resampled(docs, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), 50, least, most, percent=30, min_words=5).collect()
    want, best = resampled(rows, target, least, most, 30, 5)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(best) + 1))
    assert [r.doc_id for r in ranked] == best


def test_importance_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert importance.resampled(docs.limit(0), docs).count() == 0
    assert importance.resampled(docs, docs.limit(0), percent=100).first()["rank"] == 1


def audited(rows, min_docs, top):
    """All kept terms of all groups, written out."""
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    rows = [tuple(x or "" for x in r) for r in rows]
    for lang in {r[1] for r in rows}:
        mine = [(source, re.findall(PATTERNS[1][1], low(t))) for t, l, source in rows if l == lang]
        df = collections.Counter(x for _, w in mine for x in set(w))
        kept = {x for x, n in df.items() if n >= min_docs}
        counts = {s: collections.Counter(x for s2, w in mine if s2 == s for x in w if x in kept) for s in {s for s, _ in mine}}
        whole = sum(counts.values(), collections.Counter())
        share = lambda c, x: 1 + (c[x] + 2) * 10**9 // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        for s, c in counts.items():
            parts = {"pair": [(sum(f(share(c, x), share(d, x)) for x in kept), o) for o, d in counts.items() if o != s], "term": [(f(share(c, x), share(whole, x)), x) for x in c if share(c, x) > share(whole, x)]}
            for part, found in parts.items():
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "de", "", None]), rng.choice(["s1", "s1", "s1", "s2", "é3", None, "", "s" * 40])
        words = [rng.choice(["the", "The", "cat", "é", "漢字", "q" * 33, "q" * 33 + "r", f"rare{i}", "dog" + source[:2] if source else "x"]) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice([" ".join(words), None, " 12 "] + [" ".join(words)] * 5), lang, source))
    rows += [("alone here", "xx", "only"), (None, "yy", "a"), ("z", "yy", "b"), ("the " * 3000, "en", "s2"), *[("same text", "en", "s1")] * 40]
    docs = spark.createDataFrame([(i, *r, "t", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(5)
    for min_docs, top in ((4, 3), (1, 10), (10_000, 10)):
        got = divergence.audit(docs, min_docs, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in got.collect()) == audited(rows, min_docs, top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_blocks_of_terms_are_cut_anywhere(spark, monkeypatch):
    rows = [(f"w{i % 7} w{i % 3} all", "en", f"s{i % 5}") for i in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence._block_pairs, "__defaults__", (3,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(tuple(r) for r in divergence.audit(docs, 2).collect()) == audited(rows, 2, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shares_are_exact():
    big = [0, 1, 5, 10**9, 10**13, 9 * 10**14]
    for n in big:
        for total in (x for x in big if x >= n):
            for v in (1, 10**6):
                assert divergence.shares(np.array([n]), np.array([total]), np.array([v]))[0] == 1 + (n + 2) * 10**9 // (total + 2 * v)


def counted(t):
    t = t or ""
    w = re.findall(PATTERNS[0][1], t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = collections.Counter(windows)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(PATTERNS[0][1], line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len({i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(3)}), len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall(r"[A-Za-z\x80-\U0010FFFF]", t)), len(re.findall(r"[!-/:-@\[-`{-~]", re.sub(r"[#*$%&|<>]", "", t))), len(re.findall("[.!?]", t)), sum(bool(re.search(PATTERNS[0][1], x)) for x in t.split("\n"))


def test_quality_statistics(spark):
    ts = texts(250, 8) + ["a b c\na b c\na b c", "x y z x y z x", "A.B! C?\n\nA.B! C?\n"] + [" ".join(random.Random(i).choices("abc", k=40)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 5, "r") for i, t in enumerate(ts)] + [(None, "n", 1, ""), (3, ts[20], 1, "")], "doc_id long, text string, n_words int, rule string")
    got = quality.statistics(docs)
    assert got.columns == ["doc_id", *quality.COUNTS]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted([(i, *counted(t)) for i, t in enumerate(ts)] + [(None, *counted("n")), (3, *counted(ts[20]))], key=key)
    assert quality.statistics(docs.limit(0)).count() == 0


def test_rules_are_applied_as_they_were_learned(spark, sf):
    docs, labels = common.read_table(spark, sf.replace("0.001", "0.01"), "documents"), common.read_table(spark, sf.replace("0.001", "0.01"), "labels")
    stats = common.written(quality.statistics(docs), "statistics")
    rules = quality.fit(stats, labels)
    assert rules.rules
    rows = quality.judged(stats, rules)
    one = rows.select("*", *(F.expr(e).cast("double").alias(f"f_{k}") for k, e in quality.FEATURES.items())).toPandas()
    fixed = (one.n_words < 50) | (100 * one.n_repeat_words > 50 * one.n_words)
    assert (one.base_failed == fixed).all()
    first = [next((i for i, r in enumerate(rules.rules, 1) if all((row["f_" + t.feature] >= t.value) == t.at_least for t in r.tests)), None) for _, row in one.iterrows()]
    assert [None if b else f for b, f in zip(fixed, first, strict=True)] == [None if math.isnan(x) else int(x) for x in one["rule"].astype(float)]
    assert (one.kept == (~fixed & one["rule"].isna())).all()
    held = rows.join(labels, "doc_id").where(common.crc_mod("doc_id", 5) == 0).where("NOT base_failed").toPandas()
    assert len(held) > 30
    assert ((held.kept == 1) == (held.quality == 1)).mean() > 0.97  # 1.0 on sf0.1
    assert held[held.quality == 1].kept.mean() > 0.98


def test_rules_of_two_thresholds():
    rng = np.random.default_rng(1)
    x = {"words": rng.uniform(0, 1, 4000), "symbols_a_word": rng.uniform(0, 1, 4000), "upper_share": rng.uniform(0, 1, 4000)}
    poor = ((x["words"] > 0.8) & (x["symbols_a_word"] < 0.3)) | (x["upper_share"] > 0.9)
    rules = quality.learn(x, poor)
    assert len(rules.rules) >= 2 and max(len(r.tests) for r in rules.rules) >= 2
    assert (rules.rejects(x) == poor).mean() > 0.98
    noise = quality.learn(x, rng.uniform(0, 1, 4000) < 0.15)  # labels without a pattern: hardly a text is rejected
    assert noise.rejects(x).mean() < 0.02
    assert not quality.learn(x, np.zeros(4000, bool)).rules and not quality.learn({k: v[:0] for k, v in x.items()}, np.zeros(0, bool)).rules


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a few words only"), (2, " ".join(f"w{i}" for i in range(60))), (None, None)], "doc_id long, text string")
    got = quality.filter_quality(docs, spark.createDataFrame([(None, 0), (1, None)], "doc_id long, quality int"))
    assert sorted((str(r.doc_id), r.base_failed, r.kept, r.rule) for r in got.collect()) == [("1", True, False, None), ("2", False, True, None), ("None", True, False, None)]
