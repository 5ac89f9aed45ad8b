"""Patches of marked pixels: runs, connected components, perimeters, distances and pair correlations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import batches

KEYS = ("scan_id",)
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
FOUR = [(a, b) for a, b in EIGHT if a * b == 0]


def threshold(points: DataFrame, keys: tuple[str, ...] = KEYS, above: str = "mean") -> DataFrame:
    """(points..., mask): heights above their scan's mean."""
    return points.withColumn("mask", F.col("h") > F.avg("h").over(Window.partitionBy(*keys)))


def runs(points: DataFrame, keys: tuple[str, ...] = KEYS, periodic: bool = False) -> DataFrame:
    """(points..., patch_id): marked runs of line scans numbered from 1, 0 elsewhere; periodic: a run over the end is its first part."""
    w = Window.partitionBy(*keys).orderBy("ix")
    start = (F.col("mask") & ~F.coalesce(F.lag("mask").over(w), F.lit(False))).cast("int")
    p = points.withColumn("_s", start).withColumn("patch_id", F.when(F.col("mask"), F.sum("_s").over(w)).otherwise(F.lit(0)).cast("long")).drop("_s")
    if periodic:
        whole = Window.partitionBy(*keys)
        wraps = F.min_by("mask", "ix").over(whole) & F.max_by("mask", "ix").over(whole)
        p = p.withColumn("_last", F.max("patch_id").over(whole)).withColumn("patch_id", F.when(wraps & (F.col("patch_id") == F.col("_last")), F.lit(1).cast("long")).otherwise(F.col("patch_id"))).drop("_last")
    return p


def outer_perimeter_line(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(points..., outer): unmarked points next to marked ones."""
    w = Window.partitionBy(*keys).orderBy("ix")
    near = F.coalesce(F.lag("mask").over(w), F.lit(False)) | F.coalesce(F.lead("mask").over(w), F.lit(False))
    return points.withColumn("outer", near & ~F.col("mask"))


def coordination(points: DataFrame, nx: int, ny: int, stencil: list[tuple[int, int]] = FOUR, keys: tuple[str, ...] = KEYS, periodic: bool = False) -> DataFrame:
    """(keys, ix, iy, mask, n, outer, inner): marked neighbours of each pixel, and whether it is on either perimeter.

    Each marked pixel sends one to each neighbour; a pixel's sum is one aggregate, without self-joins.
    """
    to = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in stencil]))
    sent = points.where("mask").select(*keys, "ix", "iy", to.alias("o")).select(*keys, (F.col("ix") + F.col("o.a")).alias("ix"), (F.col("iy") + F.col("o.b")).alias("iy"))
    if periodic:
        sent = sent.withColumns({"ix": F.pmod("ix", F.lit(nx)), "iy": F.pmod("iy", F.lit(ny))})
    own = points.select(*keys, "ix", "iy", "mask", F.lit(0).alias("n"))
    both = own.unionByName(sent.select(*keys, "ix", "iy", F.lit(None).cast("boolean").alias("mask"), F.lit(1).alias("n")))
    out = both.groupBy(*keys, "ix", "iy").agg(F.bool_or("mask").alias("mask"), F.sum("n").alias("n")).where("mask IS NOT NULL")
    return out.withColumns({"outer": ~F.col("mask") & (F.col("n") > 0), "inner": F.col("mask") & (F.col("n") < len(stencil))})


def perimeter_length(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, length): digital perimeter of the marked pixels of periodic maps, by their numbers of side and corner neighbours."""
    side = coordination(points, nx, ny, FOUR, keys, True).select(*keys, "ix", "iy", "mask", F.col("n").alias("sides"))
    corner = coordination(points, nx, ny, [s for s in EIGHT if s not in FOUR], keys, True).select(*keys, "ix", "iy", F.col("n").alias("corners"))
    r2 = 2**0.5
    part = F.when(F.col("sides") >= 2, 1.0).when((F.col("sides") == 1) & (F.col("corners") >= 1), 0.5 * (1 + r2)).when(F.col("sides") == 1, 0.0).otherwise(0.5 * r2)
    return side.join(corner, [*keys, "ix", "iy"]).groupBy(*keys).agg(F.sum(F.when(F.col("mask"), part).otherwise(0.0)).alias("length"))


def labelled(mask: np.ndarray, periodic: bool, stencil: list[tuple[int, int]] = EIGHT) -> np.ndarray:
    """Components of a mask, or of each of a stack, numbered from 1 in the order in which their first pixels come row by row.

    Each root hooks on to the smallest root next to it, then all pixels jump to their roots: a number of rounds about
    the logarithm of a component's size.
    """
    stack = mask.reshape(-1, *mask.shape[-2:])
    at = np.arange(stack.size).reshape(stack.shape)
    ends = []
    for dx, dy in {max(s, (-s[0], -s[1])) for s in stencil}:
        met = np.roll(stack, (dx, dy), (1, 2)) & stack
        if not periodic:
            if dx:
                met[:, 0 if dx > 0 else -1, :] = False
            if dy:
                met[:, :, 0 if dy > 0 else -1] = False
        ends.append((at[met], np.roll(at, (dx, dy), (1, 2))[met]))
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
    root = at.ravel().copy()
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    ids = np.unique(root[stack.ravel()])
    before = np.searchsorted(ids, at[:, :1, :1])
    return np.where(stack, np.searchsorted(ids, root.reshape(stack.shape)) - before + 1, 0).reshape(mask.shape)


def patches(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS, periodic: bool = False, stencil: list[tuple[int, int]] = EIGHT) -> DataFrame:
    """(keys, ix, iy, patch_id): connected components of each map, 0 for unmarked pixels."""
    return batches.by_mask(points, nx, ny, lambda m: {"patch_id": labelled(m, periodic, stencil)}, "patch_id long", keys)


def patch_areas(ids: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return ids.where("patch_id > 0").groupBy(*keys, "patch_id").agg(F.count("*").alias("area"))


def segment_numbers(points: DataFrame, nx: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(points..., patch_id): periodic runs along ix of each row iy of maps, numbered within the row."""
    return runs(points, (*keys, "iy"), periodic=True)


def distances(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ix, iy, distance, closest): on periodic maps the distance to the nearest marked pixel, and that pixel's patch. No marked pixel: null."""

    none = np.iinfo(np.int64).max // 2
    base = nx * ny + 1

    def nearest(mask: np.ndarray) -> dict[str, np.ndarray]:
        # Distance squared and patch are one number, whose least value over both axes in turn is that over the plane.
        best = np.where(mask, labelled(mask, True), none)
        for axis, n in ((1, nx), (2, ny)):
            along = best
            for s in range(1, n // 2 + 1):
                if s * s * base > best.max():
                    break
                for way in (s, -s):
                    best = np.minimum(best, np.roll(along, way, axis) + s * s * base)
        far = best >= none
        return {"distance": np.where(far, np.nan, np.sqrt(best // base)), "closest": np.where(far, 0, best % base)}

    out = batches.by_mask(points, nx, ny, nearest, "distance double, closest long", keys)
    return out.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))


def offsets_within(most: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-most, most + 1) for b in range(-most, most + 1) if 0 < a * a + b * b <= most * most]


#: Pixels up to which maps are correlated whole, in a stack with others.
WHOLE = 1 << 20


def pair_correlation(a: DataFrame, b: DataFrame, nx: int, ny: int, most: int, keys: tuple[str, ...] = KEYS, whole: int = WHOLE) -> DataFrame:
    """(keys, r2, c, integrated): mean product of two periodic maps at each distance squared up to most squared; integrated: sums of products over distance.

    Maps of up to `whole` pixels are shifted in stacks; pixels of larger ones meet by an equi-join, which is never a broadcast:
    the optimizer would go by the size of the files that pixels come from, of which they are many times as much.
    """
    c = _products_in_stacks(a, b, nx, ny, most, keys) if nx * ny <= whole else _products_joined(a, b, nx, ny, most, keys)
    w = Window.partitionBy(*keys).orderBy("r2").rowsBetween(Window.unboundedPreceding, 0)
    return c.select(*keys, "r2", (F.col("s") / F.col("n")).alias("c"), F.sum(F.col("s") / F.sqrt(F.col("r2").cast("double"))).over(w).alias("integrated"))


def _products_joined(a: DataFrame, b: DataFrame, nx: int, ny: int, most: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, r2, s, n): sums and numbers of the products of pixels at each distance squared."""
    to = F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i, j in offsets_within(most)]))
    p = a.select(*keys, "ix", "iy", "h", to.alias("o"))
    p = p.select(*keys, F.pmod(F.col("ix") + F.col("o.a"), F.lit(nx)).alias("ix"), F.pmod(F.col("iy") + F.col("o.b"), F.lit(ny)).alias("iy"), "h", F.expr("o.a * o.a + o.b * o.b").alias("r2"))
    j = p.join(b.select(*keys, "ix", "iy", F.col("h").alias("g")).hint("merge"), [*keys, "ix", "iy"])
    return j.groupBy(*keys, "r2").agg(F.sum(F.col("h") * F.col("g")).alias("s"), F.count("*").alias("n"))


def _products_in_stacks(a: DataFrame, b: DataFrame, nx: int, ny: int, most: int, keys: tuple[str, ...]) -> DataFrame:
    """The same; null heights count as pixels without a product, absent pixels don't count."""
    one = a is b
    side = lambda p, second: p.select(*keys, F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.col("h").cast("double").alias("v"), F.lit(second).alias("second"))
    rows = side(a, False) if one else side(a, False).unionByName(side(b, True))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rings: dict[int, list[tuple[int, int]]] = {}
    for i, j in offsets_within(most):
        rings.setdefault(i * i + j * j, []).append((i, j))

    def run(table: pa.Table, starts: np.ndarray):
        ix, iy, second = (table.column(c).to_numpy() for c in ("ix", "iy", "second"))
        defined = table.column("v").is_valid().to_numpy()
        value = np.where(defined, table.column("v").to_numpy(), 0.0)
        ends = np.append(starts[1:], table.num_rows)
        for g in range(0, len(starts), step := max(1, batches.STACK // (nx * ny * 12))):
            last = min(g + step, len(starts))
            rows = slice(starts[g], ends[last - 1])
            at = np.repeat(np.arange(last - g), (ends - starts)[g:last])
            maps = []
            for part in (second[rows] == 0,) if one else (second[rows] == 0, second[rows] == 1):
                where = at[part], ix[rows][part], iy[rows][part]
                there, known, h = np.zeros((last - g, nx, ny), bool), np.zeros((last - g, nx, ny), bool), np.zeros((last - g, nx, ny))
                there[where], known[where], h[where] = True, defined[rows][part], value[rows][part]
                maps.append((there, known, h))
            for r2, offsets in rings.items():
                s, n, products = np.zeros(last - g), np.zeros(last - g, np.int64), np.zeros(last - g, np.int64)
                for o in offsets:
                    there, known, h = (np.roll(x, (-o[0], -o[1]), (1, 2)) for x in maps[-1])
                    n += (maps[0][0] & there).sum((1, 2))
                    both = maps[0][1] & known
                    products += both.sum((1, 2))
                    s += np.where(both, maps[0][2] * h, 0.0).sum((1, 2))
                hit = np.flatnonzero(n)
                yield g + hit, {"r2": np.full(len(hit), r2, np.int32), "s": s[hit], "n": n[hit], "products": products[hit]}

    out = batches.by_line(rows, keys, "r2 int, s double, n long, products long", run, "ix")
    return out.select(*keys, "r2", F.when(F.col("products") > 0, F.col("s")).alias("s"), "n")


def _ring_counts(mark: np.ndarray, n: int) -> np.ndarray:
    """How many marked pixels, images of the periodic maps included, each pixel has in the square of half width n about it."""
    for axis in (1, 2):
        size = mark.shape[axis]
        wide = np.take(mark, np.arange(-n, size + n) % size, axis)
        total = np.concatenate([np.zeros_like(np.take(wide, [0], axis)), np.cumsum(wide, axis)], axis)
        mark = np.take(total, np.arange(2 * n + 1, size + 2 * n + 1), axis) - np.take(total, np.arange(size), axis)
    return mark


def nearest_edges(starts: np.ndarray, on: np.ndarray, to: np.ndarray, most: float) -> np.ndarray:
    """Distances from marked starts to the nearest pixel of `to`, on stacks of periodic maps, square ring by square ring.

    A start's search ends with the first ring that holds no pixel of `on`, or where no farther ring can be nearer. Zero if
    it finds nothing nearer than most, or begins on a pixel of `to`.
    """
    best = np.where(to, 0.0, np.inf)
    live, before = starts & ~to, on.astype(np.int64)
    n = 0
    while live.any() and n <= most + 1:
        n += 1
        for k in range(n + 1):
            d = np.hypot(n, k)
            if d >= best[live].max():
                break
            there = np.zeros_like(to)
            for a, b in {(x * i, y * j) for i, j in ((n, k), (k, n)) for x in (1, -1) for y in (1, -1)}:
                there |= np.roll(to, (a, b), (1, 2))
            best = np.where(live & there & (d < best), d, best)
        square = _ring_counts(on.astype(np.int64), n)
        live &= (square > before) & (best > n)
        before = square
    return np.where(starts & (best < most), best, 0.0)


def shortest_distance(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS, most: float | None = None) -> DataFrame:
    """(keys, ix, iy, distance): from the pixels of periodic maps marked `start` to the nearest ones marked `target`, over patches marked `patch`.

    See nearest_edges(); most: twice nx unless given. Pixels that are not starts have distance zero. Null marks are false.
    """
    flag = lambda c, v: F.coalesce(F.col(c), F.lit(False)).cast("int") * v
    coded = points.select(*keys, "ix", "iy", (flag("start", 1) + flag("patch", 2) + flag("target", 4)).cast("double").alias("h"))
    top = float(2 * nx if most is None else most)

    def run(h: np.ndarray) -> dict[str, np.ndarray]:
        v = np.nan_to_num(h).astype(np.int64)
        return {"distance": nearest_edges(v & 1 > 0, v & 2 > 0, v & 4 > 0, top)}

    return batches.by_stack(coded, nx, ny, run, "distance double", keys, 12)
