import random
import zlib

import numpy as np
import pytest

from rugosa.llm import common, packing, tokenfile, tokens

ODD = [None, "", " ", "a  b\n\nc", "a\tb c ", "x's it's 's  q", "ab\x1cc d", "é́ ̈a b", "a\0b c", "<|endoftext|> x y<|endoftext|>", "Ünï, İstanbul. ÀÉ.\nK 12,5 a. . , b,. ﬁx", "ǅa ŉb ſs ª º", "日本語 テスト\nab", "word " * 3000 + "end", "x" * 20_000]


def library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, byte_level, spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    for most in (600_000, 5):
        e = tokens.ChunkEncoder(tokens.vocabulary(name), byte_level, most)
        assert [np.frombuffer(e.encode(t), e.dtype).tolist() for t in texts] == library(name, texts)
        ids, n = e.encode_all(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library(name, texts)
        assert len(e) <= most + 1 or most > 5


def test_portions_keep_all_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"i": list(range(9)), "text": ["x" * k for k in (0, 5, 50, 1, 1, 1, 99, 0, 3)]})
    got = list(common.portions([b, b.slice(0, 0)], "text", rows=4, size=10))
    assert [x for p in got for x in p.column("i").to_pylist()] == list(range(9))
    assert max(p.num_rows for p in got) <= 4
    assert all(p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= 10 for p in got)


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, task int").repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    ids = [*range(5, 5 + len(ODD) - 2), 5, 5]
    m = tokenfile.write_token_files(frame(spark, ODD, ids), tokens.vocabulary("byte_bpe_50k.json"), common.new_path(spark, "t"))
    want = sorted((i, len(x) + 1, crc([*x, 0])) for i, x in zip(ids, library("byte_bpe_50k.json", ODD)))
    rows = sorted(tokenfile.read_token_files(m).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.doc_id for r in rows] == sorted(ids)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_token_files_of_nothing_and_null_ids(spark):
    d = frame(spark, ["a", "b c"], [None, 3])
    m = tokenfile.write_token_files(d, tokens.vocabulary("byte_bpe_50k.json"), common.new_path(spark, "t"))
    assert [(r.doc_id, r.start) for r in tokenfile.read_token_files(m).orderBy("start").collect()] == [(None, 0), (3, 2)]
    m = tokenfile.write_token_files(d.limit(0), tokens.vocabulary("byte_bpe_50k.json"), common.new_path(spark, "t"))
    assert tokenfile.read_token_files(m).count() == 0


def checked(rows, window):
    """Pieces cover each document without a gap, sequences are gapless and not over the window; padding by sequence."""
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.row_key, []).append((r.start, r.length, r.doc_tokens))
    total = {}
    for s, p in seqs.items():
        at = 0
        for o, n in sorted(p):
            assert o == at and n > 0
            at += n
        assert at <= window
        total[s] = at
    for p in docs.values():
        at = 0
        for s, n, _ in sorted(p):
            assert s == at
            at += n
        assert at == p[0][2]
    return sum(0 if n & (n - 1) == 0 else window - n for n in total.values())


@pytest.mark.parametrize("window", [16, 256])
def test_packing(spark, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice(["one", "two", "three", "fourteen"]) for _ in range(int(rng.expovariate(1 / 40)))) for _ in range(400)] + ODD
    ids = [*range(len(texts) - 1), 3]
    got = packing.pack(frame(spark, texts, ids), tokens.vocabulary("word_bpe_49k.json"), window).collect()
    assert checked(got, window) == 0
    by = {}
    for r in got:
        by.setdefault((r.row_key, r.doc_id), []).append((r.start, r.ids, r.ids_crc32))
    for p in by.values():
        assert all(zlib.crc32(i) == c for _, i, c in p)
    whole = sorted((k[1], np.frombuffer(b"".join(i for _, i, _ in sorted(p)), "<u4").tolist()) for k, p in by.items())
    assert whole == sorted((i, [*x, 1]) for i, x in zip(ids, library("word_bpe_49k.json", texts)))


def test_packing_nothing(spark):
    assert packing.pack(frame(spark, ["a"]).limit(0), tokens.vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 500, 20_000])
def test_plan(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(rng.lognormal(6, 1.1, n).astype(int) + 1, 40_000)
    if n == 500:
        lengths[:200] = 777  # a group of copies
    hist = np.bincount(lengths % 2048, minlength=2048)
    hist[0] = 0
    plan = packing.Plan(hist, 2048)
    fill = np.zeros(plan.sequences, np.int64)
    for rest, at in plan.tables().items():
        cover = np.zeros((hist[rest], rest), np.int8) if n <= 500 else None
        for lo, hi, start, size, seq, _ in at.tolist():
            fill[seq : seq + hi - lo] += size
            if cover is not None:
                cover[lo:hi, start : start + size] += 1
        assert cover is None or (cover == 1).all()
    assert fill.sum() == (hist * np.arange(2048)).sum() and (fill <= 2048).all()
    assert sum(x & (x - 1) != 0 for x in fill.tolist()) == 0


def test_least_squares_finds_the_counts():
    hist = np.zeros(100, np.int64)
    hist[[30, 70]] = 50
    hist[[20, 40]] = 10, 20
    combos = packing.combinations_filling(hist, 100)
    x = packing.repeat_counts(hist, combos)
    assert all(sum(c) == 100 for c in combos)
    left = hist - sum(v * np.bincount(c, minlength=100) for v, c in zip(x, combos))
    assert np.abs(left).max() < 1
