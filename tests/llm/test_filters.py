import random
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rugosa.llm import embedding, license, mixing, queries, toxicity, urlfilter

TABLES = "documents embeddings pages benchmark labels".split()
DUCK = [n for n in queries.oracle_sql()]


@pytest.mark.parametrize("name", DUCK)
def test_same_rows_as_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = queries.queries()[name](spark, sf), c.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    at = [list(want.columns).index(x) for x in cols]
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


URLS = [None, "", "nothing", "http://", "http://com", "http://com/", "HTTP://A.COM/x", "http://x.example.com/en/1", "http://www.example.com/en/", "http://a.www.example.com/en/?q=/x", "http://www.example.com/EN/", "http://net/es/", "http://es.net/es", "http://a.b.c.net/fr/x#y", "http://xcom/", "http://evilexample.com/en/", "a://b://c.com/", "http://.com/", "http://..net/fr/", "http://x.com?/en/", "http://x.com#/en/", "http://é.com/", "http://" + "a." * 5000 + "net/fr/" + "z/" * 5000, "http://x.net/fr/"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, key in urlfilter.RULES:
        h, p = key.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(key) > len(best[1])):
            best = verdict, key
    return host, path, best and best[1], best[0] if best else "allow"


def test_url_rules(spark):
    rows = [(i, u, "k", "v") for i, u in enumerate(URLS)] + [(2, URLS[8], "k", "v"), (None, URLS[9], "k", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, key string, verdict string")
    got = sorted((r.page_id if r.page_id is not None else -1, r.host, r.path, str(r.rule), r.verdict) for r in urlfilter.judge(df, urlfilter.rules_frame(spark, urlfilter.RULES)).collect())
    want = sorted((-1 if i is None else i, (j := judged(u))[0], j[1], str(j[2]), j[3]) for i, u, _, _ in rows)
    assert got == want
    assert urlfilter.judge(df.limit(0), urlfilter.rules_frame(spark, urlfilter.RULES)).count() == 0
    assert {r.verdict for r in urlfilter.judge(df, spark.createDataFrame([], "verdict string, key string")).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    listed = spark.range(0, 3000, 3).selectExpr("concat('k', id) as key")
    universe = spark.range(6000).selectExpr("concat('k', id % 5000) as key")
    from pyspark.sql import functions as F

    c = urlfilter.Cascade(listed, universe, 3, rate=0.2)
    assert len(c.levels) > 2
    wrong = universe.withColumn("in", c.has(F.col("key"))).join(listed.withColumn("is", F.lit(True)), "key", "left").where("in <> coalesce(is, false)")
    assert wrong.count() == 0


def test_license_edges(spark):
    t = license.TEMPLATES[0][1]
    rows = [(1, None), (2, ""), (3, t), (4, "Some prose here.\n" + t.upper() + "\nmore prose of many words that goes on\n" + t), (5, t.replace("Apache", "Patchy")), (6, "the " * 4000), (7, "Released under the MIT License."), (7, "Released under the MIT License."), (None, t), (8, "\n\n \n")]
    got = sorted(((r.doc_id or 0), r.license, r.line, r.n_lines) for r in license.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")).collect())
    assert got[0] == (0, "Apache-2.0", 1, 1) and got[3] == (3, "Apache-2.0", 1, 1) and got[4] == (4, "Apache-2.0", 2, 2)
    assert got[1][1] is None and got[2][1] is None and got[6][1] is None and [g[1] for g in got[7:9]] == ["MIT", "MIT"] and got[9][1] is None
    a, b = (Counter(x.rsplit("#")[0] for x in license.template_bigrams(s)) for s in (rows[2][1], rows[4][1]))
    dice = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
    assert (got[5][1] is not None) == (dice >= license.LEAST)


def brute_license(text, least=license.LEAST):
    """Best (dice, piece, run, template) by comparing every unit with every template, all in Python."""
    pieces = []
    grams = {p for _, t in license.TEMPLATES for v in [re.sub(r"[\W_]+", " ", t.lower()).split()] for p in zip(v, v[1:])}
    for n, line in enumerate((text or "").lower().replace("\r", " ").split("\n"), 1):
        for s in re.split(license.SENTENCE_END, line):
            if w := re.sub(r"[\W_]+", " ", s).split():
                pieces.append((n, w))
    units = [(p + 1, k, pieces[p : p + k]) for p in range(len(pieces)) for k in range(1, len(pieces) - p + 1) if k == 1 or grams & set(zip(pieces[p][1] + pieces[p + 1][1][:1], (pieces[p][1] + pieces[p + 1][1][:1])[1:])) and grams & set(zip(pieces[p + k - 2][1][-1:] + pieces[p + k - 1][1], (pieces[p + k - 2][1][-1:] + pieces[p + k - 1][1])[1:]))]
    units += [(0, 0, pieces)] if len(pieces) > 1 else []
    best, lines = (), set()
    for p, k, of in units:
        if sum(len(x[1]) for x in of) > 400:
            continue  # over three times the longest template
        w = [y for x in of for y in x[1]]
        a = Counter(zip(w, w[1:]))
        for i, (_, t) in enumerate(license.TEMPLATES):
            v = re.sub(r"[\W_]+", " ", t.lower()).split()
            b = Counter(zip(v, v[1:]))
            dice = 2 * sum((a & b).values()) / (len(w) + len(v) - 2)
            if a and dice >= least:
                best = max(best, (dice, -p, -k, -i))
                lines |= {of[0][0]} if p else set()
    return best and (license.TEMPLATES[-best[3]][0], -best[3], best[0], pieces[-best[1] - 1][0] if best[1] else 0, -best[2]) or (None,) * 5, len(lines)


def test_license_runs(spark):
    mit = next(t for n, t in license.TEMPLATES if n == "MIT" and len(t) > 200)
    wrapped = "\n".join(textwrap.wrap(mit, 78))
    prose = "Nobody knew why a clock had stopped.\nRain fell on every roof of our town.\n"
    cc = license.TEMPLATES[4][1].replace(" Creative ", " Creative\n")
    isc = next(t for n, t in license.TEMPLATES if n == "ISC")
    seven = isc.split(" ")
    seven = "\n".join([" ".join(seven[:16]), "Copyright (c) 2021 Jane Q Public", *(" ".join(seven[i : i + 4]) for i in range(16, len(seven), 4))])
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + wrapped + "\n\n" + prose), (2, prose + cc + "\n" + prose), (3, "Our small tool is here. Released under the MIT License. Have fun with it."), (4, prose + "    GNU GENERAL PUBLIC LICENSE\n       Version 3, 29 June 2007\n\n" + prose), (5, prose), (6, mit + "\r\n" + mit), (7, (prose + cc + "\n") * 40), (8, "The license.\n" * 300), (9, None), (10, prose + seven), (11, "\n".join(textwrap.wrap(isc, 12)) + "\n" + prose), (12, "the\n" * 400), (13, "free software\n" * 60)]
    got = {r.doc_id: ((r.license, r.template, r.dice, r.line, r.pieces), r.n_lines) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0][0] for i in range(1, 14)] == ["MIT", "CC-BY-4.0", "MIT", "GPL-3.0", None, "MIT", "CC-BY-4.0", None, None, "ISC", "ISC", None, None]
    assert got == {i: brute_license(t) for i, t in rows}
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_links(rows, least=0.98):
    ok = [(i, v, k) for i, v, k in rows if i is not None and k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = Counter(), {j: j for j in range(len(ok))}

    def root(j):
        while up[j] != j:
            j = up[j]
        return j

    for a in range(len(ok)):
        for b in range(a):
            x, y = np.array(ok[a][1], float), np.array(ok[b][1], float)
            if ok[a][2] == ok[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                n[a] += 1
                n[b] += 1
                up[root(a)] = root(b)
    low = {}
    for j in range(len(ok)):
        low[root(j)] = min(low.get(root(j), ok[j][0]), ok[j][0])
    out = Counter((ok[j][0], n[j], low[root(j)]) for j in range(len(ok)))
    return out + Counter((i, 0, i) for i, v, k in rows if (i, v, k) not in ok)


@pytest.mark.parametrize("tile", [8192, 16])
def test_embedding_links(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(scale=[0, 0.05, 0.3][i % 3], size=6)], i % 2) for i in range(150)]
    nan = float("nan")
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 6, 0), (203, [1.0, nan, 0.0, 0.0, 0.0, 0.0], 0), (204, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (205, [float("inf")] * 6, 0), (206, rows[0][1], None), (207, [3.0, 4.0], 0), (208, [6.0, 8.0], 0), (209, [2 * x for x in rows[3][1]], 1), (3, rows[3][1], 1)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<double>, label int, key int, m string")
    got = embedding.near_duplicates(df, tile=tile).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = (embedding.Quantised(embedding.unit(rng.normal(size=(80, 33)))) for _ in range(2))
    d = (x.q @ y.q.T) * x.scale[:, None] * y.scale[None]
    bound = x.error[:, None] * y.norm[None] + y.error[None]
    assert (np.abs(x.u @ y.u.T - d) <= bound).all()


@pytest.mark.parametrize("block,k", [(8192, 20), (25, 7)])
def test_top_k(spark, block, k):
    rng = np.random.default_rng(k)
    vecs = [[int(v) for v in r] for r in rng.integers(-60, 60, (300, 5))]
    vecs[10:40] = [vecs[0]] * 30  # copies: ties
    vecs[50] = [0] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "vec_id long, v array<long>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in embedding.top_k(df, "vec_id % 20 = 0", k, block=block, query_block=4).collect())
    a = np.array(vecs)
    want = []
    for q in range(0, 300, 20):
        s = a @ a[q]
        best = sorted((x for x in range(300) if x != q), key=lambda x: (-s[x], x))[:k]
        want += [(q, r + 1, x, int(s[x])) for r, x in enumerate(best)]
    assert got == want
    assert embedding.top_k(df.limit(0), "true").count() == 0
    few = df.where("vec_id < 3")
    assert embedding.top_k(few, "vec_id = 0", 20).count() == 2


def test_top_k_of_repeated_ids_and_odd_vectors(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (20, [3.0, 1.0]), (20, [5.0, 5.0]), (1, [2.0, 2.0]), (40, [1.0]), (2, [4.0]), (3, None), (60, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (80, [0.0, 0.0])]
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, row int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in embedding.op8_voronoi_topk(spark, str(tmp_path)).collect())
    good = [(n, i, v) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and x == x for x in v)]
    want = []
    for n, i, v in good:
        if i % 20 == 0:
            s = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w)), j) for m, j, w in good if m != n and len(w) == len(v))
            want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    assert got == sorted(want)
    assert (20, 1, 20, 81920) in got


def toxic_frames(spark, n=900):
    rng = random.Random(3)
    ws = [a + b for a in ("an", "ber", "co", "du", "el") for b in ("ra", "si", "to", "um", "ve")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(ws) for _ in range(rng.randint(3, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["grubble"] * insult + ["folkish"] * group
        rng.shuffle(words)
        docs.append((i, " ".join(words), i % 3, 0.5))
        labels.append((i, 1, int(insult and group)))
    docs += [(n, None, 0, 0.5), (n + 1, "", 0, 0.5), (n + 2, "an " * 30_000, 0, 0.5), (None, "grubble folkish", 0, 0.5), (5, docs[5][1], 0, 0.5)]
    labels += [(n + 5, 1, 1), (None, 1, 1), (0, 1, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, held_out int, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels[:n]}


def test_toxicity_learns_pairs(spark):
    """Neither word alone is toxic, both together are: what additive weights can only place on a slope."""
    docs, labels, truth = toxic_frames(spark)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.85
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels, _ = toxic_frames(spark, 300)
    from pyspark.sql import functions as F

    from rugosa.llm import common

    flipped = labels.withColumn("toxic", F.when(common.crc_mod("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((str(r.doc_id), r.score) for r in toxicity.score_documents(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def bounded_least_squares(t, p, target, low, high, rounds=60_000):
    """Relative misses of the best totals, by plain projected gradients on all documents' rates."""
    a = (t[:, None] * p).T / target[:, None]
    r, step = np.clip(np.ones(len(t)), low, high), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(rounds):
        r = np.clip(r - step * a.T @ (a @ r - 1), low, high)
    return float(((a @ r - 1) ** 2).sum())


@pytest.mark.parametrize("low,high,want", [(0.0, np.inf, (0.8, 0.2)), (0.5, 2.0, (0.9, 0.1)), (0.0, 1.5, (0.02, 0.98))])
def test_mixing_is_the_least_squares_solution(spark, low, high, want):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef"] if i % 3 else ["cd", "gh", "kl"], 1 + i % 17)), "x" if i % 3 else "y") for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, d) for i, _, d in rows[:90]], "doc_id long, domain string")
    target = dict(zip("xy", want))
    m = mixing.Mixer(docs, labels, target, low=low, high=high, domain=F.col("domain"))
    r = m.rates().toPandas()
    t, p = r.tokens.to_numpy(float), r[["p_x", "p_y"]].to_numpy()
    aim = np.array(want) * t.sum()
    miss = float((((r.rate.to_numpy() * t) @ p / aim - 1) ** 2).sum())
    assert ((r.rate >= low) & (r.rate <= high)).all()
    least = bounded_least_squares(t, p, aim, low, high)
    assert miss <= least * 1.05 + 1e-6
    assert np.allclose(r.gap, np.abs((r.rate.to_numpy() * t) @ p - aim).sum() / aim.sum())
    assert (r.gap.iloc[0] > 0.01) == (least > 1e-4) == np.isfinite(high)


def test_calibrated_posteriors_have_the_shares_of_the_labels():
    rng = np.random.default_rng(2)
    for n in (60, 400, 2000):
        y = rng.choice(3, n, p=[0.7, 0.2, 0.1])
        rows = [np.unique(np.r_[rng.integers(0, 3000, 40), 4000 + 50 * c + rng.integers(0, 50, 3)]).astype(np.uint32) for c in y]
        m = mixing.crossfit(rows[: n // 2], y[: n // 2], list(range(n // 2)), 13, 3)
        p = m.posteriors(rows[n // 2 :]).mean(0)
        assert np.abs(p - np.bincount(y[n // 2 :], minlength=3) / (n - n // 2)).max() < (0.25 if n == 60 else 0.08)


def test_mixing_meets_targets(spark):
    docs, labels, _ = toxic_frames(spark)
    want = {"good": 0.5, "toxic": 0.5}
    m = mixing.Mixer(docs, labels, want)
    r = m.rates().collect()
    assert len(r) == docs.count() and all(x.rate >= 0 and x.copies in (int(x.rate), int(x.rate) + 1) for x in r)
    for d in want:
        total = sum(x.rate * x.tokens * x[f"p_{d}"] for x in r)
        assert total == pytest.approx(0.5 * sum(x.tokens for x in r), rel=1e-3)
    mixed = m.mixed(docs)
    assert mixed.columns == docs.columns
    assert Counter(x.doc_id for x in mixed.collect()) == Counter({d: n for d in {x.doc_id for x in r} if (n := sum(x.copies for x in r if x.doc_id == d))})
    assert all(x.copies >= 1 for x in mixing.mix_rates(docs, labels, want, low=1.0).collect())
    assert mixing.mix_rates(docs.limit(0), labels).count() == 0
    assert all(np.isfinite(x.rate) for x in mixing.mix_rates(docs, labels.limit(0)).collect())


def test_projected_gradient_against_active_bounds():
    p = np.array([[1, 0], [0, 1], [0.5, 0.5]])
    r = mixing.replayed(p, [np.array([2.0, -1.0])], 0, 1.5)
    assert r.tolist() == [0, 1.5, 0.5]


def test_pair_sum_is_that_of_a_double_loop():
    m = toxicity.FactorizationMachine(6, 3)
    rng = np.random.default_rng(0)
    m.b, m.w, m.v = 0.3, rng.normal(size=64).astype(np.float32), rng.normal(size=(64, 3)).astype(np.float32)
    rows = [np.sort(rng.choice(64, k, replace=False)).astype("<u4") for k in (0, 1, 2, 7, 40)]
    want = [m.b + sum(float(m.w[i]) for i in r) + sum(float(m.v[i].astype(float) @ m.v[j]) for a, i in enumerate(r) for j in r[a + 1 :]) / max(1, len(r)) ** 0.5 for r in rows]
    assert m.raw(rows) == pytest.approx(want, abs=1e-4)


def test_pairs_tell_apart_what_single_terms_cannot():
    rng = np.random.default_rng(2)
    words = lambda *w: np.unique(np.array([*w, *rng.choice(np.arange(8, 60), 6)], "<u4"))
    rows, y = [], []
    for _ in range(1500):  # toxic: both terms or neither of the two, in equal shares
        a, b = rng.integers(2, size=2)
        rows.append(words(a, 2 + b))
        y.append(float(a == b))
    m = toxicity.FactorizationMachine(6).fit(rows[:1000], np.array(y[:1000]))
    right = lambda m: ((m.score(rows[1000:]) >= 0.5) == (np.array(y[1000:]) > 0.5)).mean()
    assert right(m) > 0.95
    m.v = m.v * 0
    assert right(m) < 0.7


def test_one_stopping_rule_for_any_number_of_rows():
    rng = np.random.default_rng(3)
    for n in (20, 200, 3000):
        rows = [np.unique(rng.integers(0, 50, 9)).astype("<u4") for _ in range(n)]
        y = np.array([float(7 in r) for r in rows])
        m = toxicity.FactorizationMachine(6).fit(rows, y)
        assert ((m.score(rows) >= 0.5) == (y > 0.5)).mean() > 0.95
