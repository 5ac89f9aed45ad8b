"""Mixing to target weights with soft membership: classifier posteriors, then document rates by projected gradients."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import hasher, term_rows

#: Labelled rows the classifier is fitted on at most (lowest hashes of ids): a bound of the training alone.
MAX_TRAIN_ROWS = 12_000
#: The domains that the labels table tells apart, and the shares of tokens wanted of each.
TARGETS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}


def label_domain() -> Column:
    """Domain of a row of labels: toxic, else good or poor by quality; null where the label that decides is null."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic").isNotNull() & (F.col("quality") == 1), "good").when(F.col("toxic").isNotNull() & (F.col("quality") == 0), "poor")


class Softmax:
    """Multinomial logistic regression on the distinct hashed terms of a text, fitted by AdaGrad with soft thresholds.

    Logits are scaled and shifted by `scale` and `shift`, which calibrate() fits on logits of rows that no fit has seen.
    """

    def __init__(self, bits: int, classes: int):
        self.bits, self.b, self.w = bits, np.zeros(classes), np.zeros((1 << bits, classes), np.float32)
        self.scale, self.shift = 1.0, np.zeros(classes)

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.tile(self.b, (len(rows), 1))
        n = np.array([len(r) for r in rows], np.int64)
        full = np.flatnonzero(n)
        if len(full):
            at = np.concatenate([rows[i] for i in full])
            z[full] += np.add.reduceat(self.w[at].astype(np.float64), np.cumsum(n[full]) - n[full], axis=0)
        return z

    def posteriors(self, rows: list[np.ndarray]) -> np.ndarray:
        return soft(self.logits(rows) * self.scale + self.shift)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, most_epochs: int = 40, batch: int = 64, lr: float = 0.02, min_df: int = 3, seed: int = 5) -> Softmax:
        """Goes through the rows until the training loss falls by under a twentieth twice, most_epochs times at most.

        The threshold of weights falls with the square root of the number of rows, as the noise of their gradients does.
        """
        l1 = 0.06 / np.sqrt(max(1, len(rows)))
        k, rng = len(self.b), np.random.default_rng(seed)
        df = np.zeros(1 << self.bits, np.int64)
        for r in rows:
            df[r] += 1
        use = np.flatnonzero(df >= min_df)
        to = np.full(1 << self.bits, -1, np.int32)
        to[use] = np.arange(len(use), dtype=np.int32)
        rows = [(x := to[r])[x >= 0] for r in rows]
        share = (np.bincount(y, minlength=k) + 0.5) / (len(y) + 0.5 * k)
        self.b = np.log(share)
        w, g2 = np.zeros((len(use), k)), np.full((len(use), k), 1e-6)
        before, slow = np.inf, 0
        for _ in range(most_epochs if len(use) else 0):
            loss = 0.0
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                part = part[[len(rows[i]) > 0 for i in part]]
                if not len(part):
                    continue
                at = np.concatenate([rows[i] for i in part])
                n = np.array([len(rows[i]) for i in part])
                g = soft(self.b + np.add.reduceat(w[at], np.cumsum(n) - n, axis=0))
                loss -= float(np.log(np.maximum(g[np.arange(len(part)), y[part]], 1e-12)).sum())
                g[np.arange(len(part)), y[part]] -= 1
                g /= len(part)
                of = np.repeat(np.arange(len(part)), n)
                for c in range(k):
                    d = np.bincount(at, g[of, c], len(use))
                    seen = d != 0
                    g2[:, c] += d * d
                    step = lr / np.sqrt(g2[:, c])
                    v = w[:, c] - step * d
                    w[:, c] = np.where(seen, np.sign(v) * np.maximum(np.abs(v) - step * l1, 0), v)
                self.b = self.b - lr * g.sum(0)
            slow = slow + 1 if loss > 0.95 * before else 0
            if slow == 2:
                break
            before = min(before, loss)
        self.w[use] = w
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray, rounds: int = 300) -> Softmax:
        """The scale and shifts of least log loss for logits z of classes y, by Newton steps: the mean posteriors become the classes' shares."""
        k = len(self.b)
        if not len(z):
            return self
        z = z - z.mean(1, keepdims=True)
        hit = np.eye(k)[y]
        hit = (hit * len(y) + 0.5 / k) / (len(y) + 0.5)  # a class that none of the rows has keeps a finite shift
        t = np.r_[1.0, np.zeros(k)]

        def loss(t):
            u = z * t[0] + t[1:]
            u = u - u.max(1, keepdims=True)
            return float((np.log(np.exp(u).sum(1)) - (hit * u).sum(1)).mean()) + 1e-9 * float(t @ t)

        at = loss(t)
        for _ in range(rounds):
            p = soft(z * t[0] + t[1:])
            e = p - hit
            g = np.r_[(e * z).sum(1).mean(), e.mean(0)] + 2e-9 * t
            zp = (p * z).sum(1, keepdims=True)
            h = np.zeros((k + 1, k + 1))
            h[0, 0] = ((p * z * z).sum(1) - zp[:, 0] ** 2).mean()
            h[0, 1:] = h[1:, 0] = (p * (z - zp)).mean(0)
            h[1:, 1:] = np.diag(p.mean(0)) - p.T @ p / len(p)
            step = np.linalg.solve(h + 1e-8 * np.eye(k + 1), g)
            size = 1.0
            while size > 1e-6 and ((new := t - size * step)[0] < 0 or loss(new) > at):
                size /= 2
            if size <= 1e-6 or at - loss(new) < 1e-12:
                break
            t, at = new, loss(new)
        # z was centred, which a softmax does not see.
        self.scale, self.shift = float(t[0]), t[1:]
        return self


def soft(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", bits: int = 16, max_rows: int = MAX_TRAIN_ROWS) -> Softmax:
    """A classifier of the labelled table's domains; rows of other or no domains are left out. No labels: the same posteriors for all.

    Three fits on two thirds each (by a hash of the id) give logits of rows they have not seen, which calibrate the fit on all.
    """
    lab = labels.select(F.col(id_col).alias("id"), (label_domain() if domain is None else domain).alias("domain")).where(F.col("id").isNotNull() & F.col("domain").isin(domains))
    lab = lab.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), "id")  # lab has max_rows rows at most

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher(bits)
        for b in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), b.column("domain"), pa.array([h.terms(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["id", "domain", "terms"])

    got = train.mapInArrow(terms, "id long, domain string, terms binary").dropDuplicates(["id", "terms"]).orderBy(F.xxhash64("id"), F.col("id"), F.crc32("terms")).limit(max_rows)

    def make(table: pa.Table) -> Softmax:
        y = np.array([domains.index(d) for d in table.column("domain").to_pylist()], np.int64)
        return crossfit(term_rows(table.column("terms")), y, table.column("id").to_pylist(), bits, len(domains))

    return common.made_by_task(got, make) or crossfit([], np.empty(0, np.int64), [], bits, len(domains))


def crossfit(rows: list[np.ndarray], y: np.ndarray, ids: list[int], bits: int, classes: int, folds: int = 3) -> Softmax:
    """A fit on all rows, calibrated by the logits that fits without a fold give that fold; a fold goes by the id, so copies of a row share it."""
    fold = np.array([zlib.crc32(b"fold%d" % i) % folds for i in ids], np.int64)
    of = lambda keep: [r for r, k in zip(rows, keep, strict=True) if k]
    z = np.zeros((len(rows), classes))
    for f in range(folds):
        if (fold == f).any():
            z[fold == f] = Softmax(bits, classes).fit(of(fold != f), y[fold != f]).logits(of(fold == f))
    return Softmax(bits, classes).fit(rows, y).calibrate(z, y)


def replayed(p: np.ndarray, steps: list[np.ndarray], low: float, high: float) -> np.ndarray:
    """The rates after these gradient steps: each rate starts at 1 and is projected onto [low, high] after each step."""
    r = np.clip(np.ones(len(p)), low, high)
    for g in steps:
        r = np.clip(r - p @ g, low, high)
    return r


class Mixer:
    """Document rates r in [low, high] whose expected domain tokens sum_d r_d t_d p_dk come closest to the target totals.

    The targets are shares of budget_factor times the tokens of docs. Least squares of the
    totals' misses relative to the targets, by projected gradients: an iteration tries the gradient as it is, scaled
    by the inverse Gram matrix of t p p', and by that of the documents whose rates are off their bounds, at several step
    lengths, and takes the best. A
    document's rate depends on its posteriors and the steps (domains numbers each) alone, so no rates are stored: each
    iteration is one pass over (tokens, posteriors) that replays the steps so far and sums the totals. `high` is a wish
    of the caller, unbounded if not given. gap: the sum of what the totals miss of the targets, as a share of them;
    more than `tolerance` where the targets are out of reach.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget_factor: float = 1.0, low: float = 0.0, high: float = np.inf, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", iterations: int = 25, tolerance: float = 1e-4):
        self.domains, self.low, self.high, self.text_col = list(targets), low, high, text_col
        k = len(self.domains)
        self.model = fit_classifier(docs, labels, self.domains, domain, id_col, text_col)
        self.held = docs.sparkSession.sparkContext.broadcast(self.model)
        held, low_, high_ = self.held, low, high

        def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.pieces(batches):
                t, p = measured(held.value, b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(t), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["doc_id", "tokens", "p"])

        self.table = common.written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(compact, "doc_id long, tokens long, p array<double>"), "posteriors")

        def passed(steps: list[np.ndarray], nexts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
            """For each next step: totals by domain at the rates after it, and the Gram matrix of the documents whose rates are off their bounds then."""
            each = k + k * k

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros((len(nexts), each))
                for b in batches:
                    p = b.column("p").flatten().to_numpy().reshape(-1, k)
                    t = b.column("tokens").to_numpy().astype(np.float64)
                    at = replayed(p, steps, low_, high_)
                    for i, g in enumerate(nexts):
                        r = np.clip(at - p @ g, low_, high_)
                        free = t * ((r > low_) & (r < high_))
                        out[i] += np.r_[(r * t) @ p, ((p * free[:, None]).T @ p).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(out.ravel()), pa.array(np.arange(out.size, dtype=np.int32))], names=["v", "i"])

            got = self.table.select("tokens", "p").mapInArrow(sums, "v double, i int").groupBy("i").agg(F.sum("v")).collect()  # as many rows as steps times domains and their squares
            out = np.zeros(len(nexts) * each)
            for i, v in got:
                out[i] = v
            return [(x[:k], x[k:].reshape(k, k)) for x in out.reshape(-1, each)]

        def inverse(gram: np.ndarray) -> np.ndarray:
            return np.linalg.pinv(gram + np.eye(k) * 1e-9 * max(gram.trace(), 1e-300), hermitian=True)

        self.steps: list[np.ndarray] = []
        (self.before, free), whole = passed([], [np.zeros(k)])[0], self.gram_of_all()
        total = float(self.table.agg(F.sum("tokens")).first()[0] or 0)
        share = np.array([targets[d] for d in self.domains], np.float64)
        self.target = share / share.sum() * total * budget_factor if share.sum() > 0 else np.zeros(k)
        self.after, near = self.before, inverse(whole)
        weight = 1 / np.maximum(self.target, 1e-3 * max(total, 1.0)) ** 2
        missed = lambda s: float(weight @ (s - self.target) ** 2)
        for _ in range(iterations if total > 0 else 0):
            gap = self.after - self.target
            if np.abs(gap).sum() <= tolerance * self.target.sum():
                break
            g = inverse(free + 1e-6 * whole) @ gap
            plain = weight * gap / max(np.linalg.eigvalsh((whole * np.sqrt(weight)).T * np.sqrt(weight)).max(), 1e-300)  # a step of least squares itself
            nexts = [near @ gap, *(g * x for x in (1.0, 0.5, 0.25, 0.1, 0.03)), plain, plain * 8]
            tried = passed(self.steps, nexts)
            best = min(range(len(nexts)), key=lambda i: missed(tried[i][0]))
            if missed(tried[best][0]) > missed(self.after) * (1 - 1e-6):  # the bounds allow no nearer totals
                break
            self.steps.append(nexts[best])
            self.after, free = tried[best]
        self.gap = float(np.abs(self.after - self.target).sum() / self.target.sum()) if total > 0 and self.target.sum() > 0 else 0.0

    def gram_of_all(self) -> np.ndarray:
        """The Gram matrix of t p p' over all documents."""
        k = len(self.domains)
        p, t = F.col("p"), F.col("tokens").cast("double")
        r = self.table.agg(*[F.sum(t * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
        return np.array([x or 0.0 for x in r]).reshape(k, k)

    def rates(self) -> DataFrame:
        """(doc_id, tokens, p_<domain>..., rate, copies, gap) of every row."""
        gap, steps, low, high, names, k = self.gap, self.steps, self.low, self.high, [f"p_{d}" for d in self.domains], len(self.domains)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = b.column("p").flatten().to_numpy().reshape(-1, k)
                r = replayed(p, steps, low, high)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tokens"), *map(pa.array, p.T.copy()), pa.array(r), pa.array(copies_of(b.column("doc_id").to_pylist(), r)), pa.array(np.full(len(r), gap))], names=["doc_id", "tokens", *names, "rate", "copies", "gap"])

        return self.table.mapInArrow(run, "doc_id long, tokens long, " + ", ".join(f"`{n}` double" for n in names) + ", rate double, copies int, gap double")

    def mixed(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """The rows of docs, with all their columns, each as often as its rate says; fractions are decided by the id."""
        steps, low, high, held, text_col = self.steps, self.low, self.high, self.held, self.text_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.pieces(batches):
                _, p = measured(held.value, b.column(text_col).to_pylist())
                n = copies_of(b.column(id_col).to_pylist(), replayed(p, steps, low, high))
                yield b.take(pa.array(np.repeat(np.arange(b.num_rows), n)))

        return docs.mapInArrow(run, docs.schema)


def measured(model: Softmax, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (words parted by white space) and domain posteriors of texts."""
    h = hasher(model.bits)
    return np.array([len((t or "").split()) for t in texts], np.int64), model.posteriors([h.terms(t) for t in texts])


def copies_of(ids: list[int | None], rates: np.ndarray) -> np.ndarray:
    """floor(rate + u), u in [0, 1) from the id: the expected number of copies is the rate."""
    u = np.array([zlib.crc32(b"mix" + (b"" if i is None else str(i).encode())) for i in ids], np.float64) / 2**32
    return np.floor(rates + u).astype(np.int32)


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """(doc_id, tokens, p_<domain>, rate, copies, gap) of every row of docs, so that expected domain tokens match the targets.

    Null and empty texts have no tokens and the posteriors of no terms. Rows that repeat an id have equal rates if
    their texts are equal. Targets out of reach of the bounds: the
    nearest totals, and gap says by how much of the targets they miss. An empty table gives no rows.
    """
    return Mixer(docs, labels, targets or TARGETS, **options).rates()


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_rates(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


QUERIES = {"op1_mixing": op1_mixing}
