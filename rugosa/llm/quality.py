"""Quality rules: ordered decision lists learned from labelled statistics of texts, applied as Spark expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords, common

#: Labelled rows that rules are learned from at most, the ids whose hashes are lowest: a bound of the training, not of what is judged.
MAX_TRAIN_ROWS = 16_000
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_letters", "n_marks", "n_ends", "n_lines"]
#: What rules may test: numbers of a text that don't depend on how long it is, and its length.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "words_an_end": "n_words / (n_ends + 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
}
_SYMBOL, _UPPER, _CONTINUED = np.zeros(256, bool), bytewords.table((65, 90)), bytewords.table((128, 191))
_SYMBOL[list(SYMBOLS.encode())] = True
_MARK = bytewords.table((33, 47), (58, 64), (91, 96), (123, 126)) & ~_SYMBOL
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def _repeated(texts: np.ndarray, ids: np.ndarray, n: int, k: int = 3) -> np.ndarray:
    """Words of each of n texts that lie in a window of k words found twice or more in it; each word counts once."""
    if len(ids) < k:
        return np.zeros(n, np.int64)
    code = ids
    for j in range(1, k):  # equal windows get equal codes, exactly: each step pairs two codes under 2**31
        code = np.unique(code[:-1] * (ids.max() + 1) + ids[j:], return_inverse=True)[1]
    whole = np.flatnonzero(texts[: len(code)] == texts[k - 1 :])
    _, at, times = np.unique(texts[whole] * (code.max() + 1) + code[whole], return_inverse=True, return_counts=True)
    hit = np.zeros(len(ids), bool)
    twice = whole[times[at] > 1]
    for j in range(k):
        hit[twice + j] = True
    return np.bincount(texts[hit], minlength=n)


def _counts(column: pa.Array) -> dict[str, np.ndarray]:
    w = bytewords.ByteWords(column, bytewords.NO_SPACE, fold=False)
    n, raw, ends = len(column), w.buf[: -bytewords.LONG], w.offsets
    texts, (ids, _) = w.texts_of(), bytewords.grouped(w.buf, w.starts, w.lengths)
    breaks = np.flatnonzero(raw == 10)
    of = np.searchsorted(ends, breaks, side="right") - 1
    starts = np.sort(np.concatenate([ends[:-1], breaks + 1]), kind="stable")  # of lines; each text has one at least
    line_text = np.sort(np.concatenate([np.arange(n), of]), kind="stable")
    stops = np.minimum(np.append(starts[1:], len(raw)), ends[1:][line_text])
    stops -= (stops > starts) & (raw[np.maximum(stops - 1, 0)] == 10) if len(raw) else 0
    with_word = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, starts)
    starts, stops, line_text = starts[with_word], stops[with_word], line_text[with_word]
    line_ids, lines = bytewords.grouped(w.buf, starts, stops - starts)
    distinct = np.unique(line_text * max(1, len(lines)) + line_ids) // max(1, len(lines))
    n_lines = np.bincount(line_text, minlength=n)
    in_words = np.repeat(texts, w.lengths)
    at = np.arange(len(in_words)) + np.repeat(w.starts - np.cumsum(w.lengths) + w.lengths, w.lengths)
    return {
        "n_words": w.counts(),
        "word_chars": np.bincount(in_words[~_CONTINUED[raw[at]]], minlength=n),
        "n_symbols": bytewords.shares(_SYMBOL[raw], ends),
        "n_dup_lines": n_lines - np.bincount(distinct, minlength=n),
        "n_repeat_words": _repeated(texts, ids, n),
        "n_distinct": np.bincount(np.unique(texts * (len(ids) + 1) + ids) // (len(ids) + 1), minlength=n),
        "n_upper": bytewords.shares(_UPPER[raw], ends),
        "n_letters": bytewords.shares(bytewords.LETTERS[raw] & ~_CONTINUED[raw], ends),
        "n_marks": bytewords.shares(_MARK[raw], ends),
        "n_ends": bytewords.shares(_END[raw], ends),
        "n_lines": n_lines,
    }


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS as longs) of every row and whole text; null texts count as empty, null ids stay null.

    Words are runs without ASCII white space; word_chars counts their characters; a duplicate line has a
    word and equals an earlier line of its text; repeated words lie in windows of three that occur
    twice or more. Lines are counted if they hold a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.portions(batches, "text", size=2 << 20):
            got = _counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)]))


def base_failed() -> Column:
    """The fixed rule: too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """One threshold: feature >= value, or feature < value."""

    feature: str
    at_least: bool
    value: float

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value:.6g}"

    def hits(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] < self.value

    def column(self) -> Column:
        c = F.expr(FEATURES[self.feature])
        return c >= F.lit(self.value) if self.at_least else c < F.lit(self.value)


@dataclass
class Rule:
    tests: list[Test]
    covered: int = 0
    wrong: int = 0

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests)) + f" ({self.covered - self.wrong} of {self.covered} labelled texts are poor)"

    def hits(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.hits(x) for t in self.tests])


@dataclass
class DecisionList:
    """Rules in order, each of which rejects; a text that none fits is kept."""

    rules: list[Rule] = field(default_factory=list)

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        return np.logical_or.reduce([np.zeros(n, bool), *(r.hits(x) for r in self.rules)])

    def rule_column(self) -> Column:
        """The place of the first rule that fits, from 1 on; null if none does."""
        out = F.lit(None).cast("int")
        for i, r in reversed(list(enumerate(self.rules, 1))):
            fits = r.tests[0].column()
            for t in r.tests[1:]:
                fits = fits & t.column()
            out = F.when(fits, F.lit(i)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(["if " + str(r) + ": reject" for r in self.rules] + ["else: keep"])


def thresholds(values: np.ndarray, most: int = 64) -> np.ndarray:
    """Midpoints between neighbouring distinct values, at most `most`, evenly spread over the rows."""
    v = np.unique(values)
    cuts = (v[1:] + v[:-1]) / 2
    if len(cuts) > most:
        cuts = np.unique(cuts[np.searchsorted(cuts, np.quantile(values, np.linspace(0, 1, most + 2)[1:-1])).clip(0, len(cuts) - 1)])
    return cuts


def grow(x: dict[str, np.ndarray], poor: np.ndarray, most_tests: int = 4) -> list[Test]:
    """A conjunction that covers poor texts and no other, if it can: each test added is that of most information gain over what is left."""
    tests: list[Test] = []
    on = np.ones(len(poor), bool)
    while len(tests) < most_tests and poor[on].any() and not poor[on].all():
        p, n = int(poor[on].sum()), int((~poor[on]).sum())
        was, best = np.log2(p / (p + n)), (1e-9, None)
        for name, values in x.items():
            v = values[on]
            cuts = thresholds(v)
            if not len(cuts):
                continue
            place = np.searchsorted(cuts, v, side="right")  # cuts at or below each value
            below_p = np.cumsum(np.bincount(place[poor[on]], minlength=len(cuts) + 1))[:-1]
            below_n = np.cumsum(np.bincount(place[~poor[on]], minlength=len(cuts) + 1))[:-1]
            for at_least, ps, ns in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - was), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = gain[i], Test(name, at_least, float(cuts[i]))
        if best[1] is None:
            break
        tests.append(best[1])
        on &= best[1].hits(x)
    return tests


def prune(tests: list[Test], x: dict[str, np.ndarray], poor: np.ndarray) -> list[Test]:
    """The beginning of the conjunction that does best on rows it was not grown on: (poor - others) over all it covers, the shortest if equal."""
    best, out = -2.0, tests
    for k in range(1, len(tests) + 1):
        on = Rule(tests[:k]).hits(x)
        p, n = int(poor[on].sum()), int((~poor[on]).sum())
        worth = (p - n) / (p + n + 1)
        if worth > best + 1e-12:
            best, out = worth, tests[:k]
    return out


def learn(x: dict[str, np.ndarray], poor: np.ndarray, most_rules: int = 16, precision: float = 0.9, least: int = 4, seed: int = 3) -> DecisionList:
    """Sequential covering: rules are grown on two thirds of the rows left and pruned on the rest, until one isn't right in `precision` of what it covers on both."""
    out, rng = DecisionList(), np.random.default_rng(seed)
    left = np.arange(len(poor))
    for _ in range(most_rules):
        pick = lambda at: ({k: v[at] for k, v in x.items()}, poor[at])
        if poor[left].sum() < least:
            break
        third = rng.permutation(np.arange(len(left)) % 3)
        tests = grow(*pick(left[third > 0]))
        if not tests:
            break
        tests = prune(tests, *pick(left[third == 0]))
        rule = Rule(tests)
        unseen, all_left = rule.hits(pick(left[third == 0])[0]), rule.hits(pick(left)[0])
        rule.covered, rule.wrong = int(all_left.sum()), int((~poor[left][all_left]).sum())
        held = poor[left[third == 0]][unseen]
        if rule.covered < least or rule.wrong > (1 - precision) * rule.covered or (len(held) and held.mean() < precision):
            break
        out.rules.append(rule)
        left = left[~all_left]
    return out


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS, **kw) -> DecisionList:
    """A list from labelled texts that the fixed rule passes (label 0: poor). Rows without a label or id are left out, of several labels the
    smallest counts; the ids of crc32 modulo 5 = 0 are never used, so that the list can be held against them. No label: an empty list, which keeps all.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(common.crc_mod("doc_id", 5) != 0)
    lab = lab.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = stats.join(F.broadcast(lab), "doc_id").where(~base_failed())  # lab has max_rows rows at most
    rows = rows.select("doc_id", "y", *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items())).distinct()
    got = rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(max_rows).toArrow()
    return learn({k: got.column(k).to_numpy() for k in FEATURES}, got.column("y").to_numpy() == 0, **kw)


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """With base_failed, rule (the first that fits, null if none) and kept."""
    rows = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rules.rule_column()))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the statistics, base_failed, rule, kept) of every row of docs. Texts are read once: their statistics are a small table, from which rules are learned and which they judge."""
    stats = common.written(statistics(docs), "statistics")
    return judged(stats, fit(stats, labels))


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The fixed rule's counts of all documents, and the verdict of a list learned from labels.quality."""
    out = filter_quality(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")


QUERIES = {"op11_quality_rules": op11_quality_rules}
