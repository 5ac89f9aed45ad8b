"""Patches and distances on maps larger than a task: tiles, rows and columns are worked on apart and put together by joins of their borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written
from . import batches
from .geometry import EIGHT, FOUR, labelled
from .ordered import running_sums

KEYS = ("scan_id",)


def linked(edges: DataFrame, keys: tuple[str, ...], most_rounds: int = 60) -> DataFrame:
    """(keys, node, low): the smallest node that each node of (keys, a, b) reaches; nodes without links are absent.

    Alternating rounds: each node's larger neighbours are tied to its smallest one, then each node's smaller ones,
    until nothing changes. A hub is only ever one side of a join whose other side has one row a node.
    """
    down = lambda e: e.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, before = written(down(edges), "links"), None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            both = e.select(*keys, F.col("a").alias("node"), F.col("b").alias("low"))
            return both.unionAll(e.select(*keys, F.col("b").alias("node"), F.col("b").alias("low")).distinct())
        before = now
        ways = e.select(*keys, "a", "b").unionAll(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = written(down(ways.where("b > a").join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("low").alias("b"))), "links")
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("low"))
        small = large.join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("low").alias("b"))
        new = written(down(small.unionAll(low.select(*keys, "a", F.col("low").alias("b")))), "links")
        for t in (e, large):
            dropped(t)
        e = new
    raise RuntimeError("linked: no end of rounds")


def _tile_roots(points: DataFrame, ny: int, tile: int, stencil: list[tuple[int, int]], keys: tuple[str, ...]) -> DataFrame:
    """(keys, ix, iy, root, rim): each marked pixel's patch within its tile, by the place ix * ny + iy of the patch's first pixel; rim: at the tile's border."""
    kinds = "".join(f"{c} {t}, " for c, t in points.select(*keys).dtypes)
    at = points.where("mask").select(*keys, F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"))
    at = at.withColumns({"_tx": F.expr(f"ix div {tile}"), "_ty": F.expr(f"iy div {tile}")})

    def run(table: pa.Table) -> pa.Table:
        ix, iy = (table.column(c).to_numpy() for c in ("ix", "iy"))
        x, y = ix % tile, iy % tile
        mask = np.zeros((tile, tile), bool)
        mask[x, y] = True
        ids = labelled(mask, False, stencil)[x, y]
        place = ix.astype(np.int64) * ny + iy
        first = np.full(ids.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, ids, place)
        rim = (x == 0) | (y == 0) | (x == tile - 1) | (y == tile - 1)
        return pa.table([*(table.column(k) for k in keys), pa.array(ix), pa.array(iy), pa.array(first[ids]), pa.array(rim)], names=[*keys, "ix", "iy", "root", "rim"])

    return at.groupBy(*keys, "_tx", "_ty").applyInArrow(run, f"{kinds}ix int, iy int, root long, rim boolean")


def patches(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS, periodic: bool = False, stencil: list[tuple[int, int]] = EIGHT, tile: int = 1024) -> DataFrame:
    """(keys, ix, iy, patch_id): as geometry.patches, of maps of any size.

    Tiles are labelled on their own. Their border pixels, and the map's if it is periodic, meet their neighbours in other
    tiles by an equi-join; the links between patches of tiles are far fewer than pixels, and
    their connected components make patches of the map, numbered in the order of their first pixels.
    """
    known = written(_tile_roots(points, ny, tile, stencil, keys), "tiles")
    edge = known.where(F.col("rim") | (F.col("ix") == nx - 1) | (F.col("iy") == ny - 1)).select(*keys, "ix", "iy", "root")
    half = [s for s in stencil if s > (0, 0)]
    to = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in half]))
    sent = edge.select(*keys, "ix", "iy", "root", to.alias("o")).select(*keys, (F.col("ix") + F.col("o.a")).alias("ix"), (F.col("iy") + F.col("o.b")).alias("iy"), F.col("root").alias("a"))
    if periodic:
        sent = sent.withColumns({"ix": F.pmod("ix", F.lit(nx)), "iy": F.pmod("iy", F.lit(ny))})
    links = sent.join(edge.withColumnRenamed("root", "b"), [*keys, "ix", "iy"]).where("a <> b").select(*keys, "a", "b").distinct()
    low = linked(links, keys).withColumnRenamed("node", "root")
    one = written(known.select(*keys, "root").distinct().join(low, [*keys, "root"], "left").withColumn("low", F.coalesce("low", "root")), "roots")
    lows = one.select(*keys, "low", F.lit(1).cast("long").alias("one")).distinct()
    number = running_sums(lows, keys, ["low"], {"before": "one"}).select(*keys, "low", (F.col("before") + 1).alias("patch_id"))
    marked = known.join(one.join(number, [*keys, "low"]), [*keys, "root"]).select(*keys, "ix", "iy", "patch_id")
    return points.select(*keys, F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy")).join(marked, [*keys, "ix", "iy"], "left").withColumn("patch_id", F.coalesce("patch_id", F.lit(0).cast("long")))


def distances(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS, **kw) -> DataFrame:
    """(keys, ix, iy, distance, closest): as geometry.distances, on periodic maps of any size; kw as patches().

    The square of a distance is least over a row first and then over a column: rows are worked on in one set of tasks and
    columns in another, so a task holds lines, not maps. Absent pixels count as unmarked.
    """
    ids = patches(points, nx, ny, keys, periodic=True, **kw).select(*keys, "ix", "iy", "patch_id")
    rows = _nearest(ids.select(*keys, "ix", "iy", F.when(F.col("patch_id") > 0, F.struct(F.lit(0).cast("long").alias("d"), "patch_id")).alias("best")), "iy", ny, (*keys, "ix"), keys)
    out = _nearest(rows, "ix", nx, (*keys, "iy"), keys)
    return out.select(*keys, "ix", "iy", F.sqrt(F.col("best.d").cast("double")).alias("distance"), F.coalesce(F.col("best.patch_id"), F.lit(0).cast("long")).alias("closest"))


def _nearest(pixels: DataFrame, along: str, n: int, line: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """best (d, patch_id) of each pixel: the least over the periodic line of a pixel's best with the distance squared added, smaller patches first among equals."""
    far = np.iinfo(np.int64).max // 4

    def run(table: pa.Table, starts: np.ndarray):
        at, d, p = (table.column(c).to_numpy() for c in ("at", "d", "p"))
        ends = np.append(starts[1:], table.num_rows)
        for g in range(0, len(starts), most := max(1, batches.STACK // n)):
            last = min(g + most, len(starts))
            rows = slice(starts[g], ends[last - 1])
            of = np.repeat(np.arange(last - g), (ends - starts)[g:last])
            base_d, base_p = np.full((last - g, n), far), np.zeros((last - g, n), np.int64)
            base_d[of, at[rows]], base_p[of, at[rows]] = d[rows], p[rows]
            best_d, best_p = base_d.copy(), base_p.copy()
            for s in range(1, n // 2 + 1):
                if s * s > best_d.max():
                    break
                for way in (s, -s):
                    new_d, new_p = np.roll(base_d, way, 1) + s * s, np.roll(base_p, way, 1)
                    nearer = (new_d < best_d) | ((new_d == best_d) & (new_p < best_p))
                    best_d, best_p = np.where(nearer, new_d, best_d), np.where(nearer, new_p, best_p)
            yield g + of, {along: at[rows], "d": np.minimum(best_d[of, at[rows]], far), "patch_id": best_p[of, at[rows]]}

    values = [F.col(along).cast("int").alias("at"), F.coalesce(F.col("best.d"), F.lit(far)).alias("d"), F.coalesce(F.col("best.patch_id"), F.lit(0).cast("long")).alias("p")]
    out = batches.by_line(pixels.select(*line, *values), line, f"{along} int, d long, patch_id long", run)
    return out.select(*keys, "ix", "iy", F.when(F.col("d") < far, F.struct("d", "patch_id")).alias("best"))


# --- holes -----------------------------------------------------------------------------------------

#: Pixels up to which a map's holes are found whole, in a stack with others.
WHOLE = 1 << 20


def fill_harmonic(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS, periodic: bool = False, whole: int = WHOLE, tile: int = 1024) -> DataFrame:
    """(keys, ix, iy, h): undefined heights (null or NaN) of maps as the harmonic function with the defined ones about them as boundary.

    Each hole, undefined pixels that touch by their sides, is a problem of its own, and many small ones are solved at once. Maps
    of up to `whole` pixels are filled whole, in one pass; of larger ones, a hole's pixels and the defined ones next to it
    come together, and holes are spread over tasks. At a nonperiodic map's edge nothing flows
    out. A map without any defined height stays undefined.
    """
    if nx * ny <= whole:
        return _fill_whole(points, nx, ny, keys, periodic)
    flagged = points.select(*keys, F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.when(~F.isnan("h"), F.col("h").cast("double")).alias("h")).withColumn("mask", F.col("h").isNull())
    ids = patches(flagged, nx, ny, keys, periodic, FOUR, tile)
    holes = written(ids.where("patch_id > 0").select(*keys, "ix", "iy", "patch_id"), "holes")
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in FOUR]))
    ring = holes.select(*keys, "patch_id", "ix", "iy", near.alias("o")).select(*keys, "patch_id", (F.col("ix") + F.col("o.a")).alias("ix"), (F.col("iy") + F.col("o.b")).alias("iy"))
    if periodic:
        ring = ring.withColumns({"ix": F.pmod("ix", F.lit(nx)).cast("int"), "iy": F.pmod("iy", F.lit(ny)).cast("int")})
    # Merged: the table of holes is small in its file and so would be broadcast, and a task that reads maps would hold the rings of all.
    ring = ring.join(flagged.where("NOT mask").drop("mask").hint("merge"), [*keys, "ix", "iy"]).distinct()
    rows = holes.withColumn("h", F.lit(None).cast("double")).unionByName(ring).withColumn("at", F.col("ix").cast("long") * ny + F.col("iy"))

    def run(table: pa.Table, starts: np.ndarray):
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        ix, iy, h = (table.column(c).to_numpy() for c in ("ix", "iy", "h"))
        u = solved(of, ix, iy, h, nx, ny, periodic)
        hole = np.isnan(h)
        yield of[hole], {"ix": ix[hole], "iy": iy[hole], "h": u[hole]}

    filled = batches.by_line(rows, (*keys, "patch_id"), "ix int, iy int, h double", run).drop("patch_id").withColumnRenamed("h", "_u")
    out = flagged.join(filled.hint("merge"), [*keys, "ix", "iy"], "left")
    return out.select(*keys, "ix", "iy", F.coalesce("h", F.nanvl("_u", F.lit(None).cast("double"))).alias("h"))


def _fill_whole(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...], periodic: bool) -> DataFrame:
    """fill_harmonic of maps that fit in a task, in stacks: one shuffle by map and no join."""

    def run(table: pa.Table, starts: np.ndarray):
        for g, at, x, y, stack in batches.stacks(table, starts, nx, ny, np.nan, 4):
            given = np.zeros(stack.shape, bool)
            given[at, x, y] = True
            fill_stack(stack, given, periodic)
            yield g + at, {"ix": x, "iy": y, "h": stack[at, x, y]}

    out = batches.by_group(points, keys, batches.pixels("cast(h as double)"), "ix int, iy int, h double", run)
    return out.select(*keys, "ix", "iy", F.nanvl("h", F.lit(None).cast("double")).alias("h"))


def fill_stack(stack: np.ndarray, given: np.ndarray, periodic: bool) -> None:
    """Fills the NaN pixels of maps n x nx x ny that are given; the others are no part of the maps."""
    n, nx, ny = stack.shape
    hole = given & np.isnan(stack)
    ids = labelled(hole, periodic, FOUR)
    most = ids.reshape(n, -1).max(1)
    m, x, y = (a.astype(np.int64) for a in np.nonzero(hole))
    if not len(m):
        return
    of = (np.cumsum(most) - most)[m] + ids[m, x, y] - 1
    rings = []
    for a, b in FOUR:
        tx, ty = x + a, y + b
        ok = np.ones(len(m), bool) if periodic else (tx >= 0) & (tx < nx) & (ty >= 0) & (ty < ny)
        k, mk, tx, ty = of[ok], m[ok], tx[ok] % nx, ty[ok] % ny
        ok = given[mk, tx, ty] & ~hole[mk, tx, ty]
        rings.append(((k * n + mk) * nx + tx)[ok] * ny + ty[ok])
    ring = np.unique(np.concatenate(rings))  # a defined pixel once for each hole it borders on
    rest, ry = np.divmod(ring, ny)
    rest, rx = np.divmod(rest, nx)
    ro, rm = np.divmod(rest, n)
    u = solved(np.concatenate([of, ro]), np.concatenate([x, rx]), np.concatenate([y, ry]), np.concatenate([np.full(len(m), np.nan), stack[rm, rx, ry]]), nx, ny, periodic)
    stack[m, x, y] = u[: len(m)]


def solved(of: np.ndarray, ix: np.ndarray, iy: np.ndarray, h: np.ndarray, nx: int, ny: int, periodic: bool, tol: float = 1e-13) -> np.ndarray:
    """Harmonic heights of many holes at once: pixels (of, ix, iy) of hole number `of`, h NaN where wanted. Conjugate gradients with each hole's own step; NaN for holes without a boundary."""
    place = (of.astype(np.int64) * nx + ix) * ny + iy
    order = np.argsort(place)
    place, hole, n = place[order], np.isnan(h)[order], int(of.max()) + 1 if len(of) else 0
    g, x, y = of[order], ix[order].astype(np.int64), iy[order].astype(np.int64)
    left, right = [], []
    for a, b in ((1, 0), (0, 1)):
        tx, ty = x + a, y + b
        inside = np.ones(len(x), bool) if periodic else (tx < nx) & (ty < ny)
        to = (g * np.int64(nx) + tx % nx) * ny + ty % ny
        at = np.searchsorted(place, to).clip(0, len(place) - 1)
        ok = inside & (place[at] == to) & (at != np.arange(len(at))) & (hole | hole[at])  # what binds two boundary pixels doesn't count
        left.append(np.flatnonzero(ok))
        right.append(at[ok])
    i, j = np.concatenate(left), np.concatenate(right)

    def laplace(v: np.ndarray) -> np.ndarray:
        d = v[i] - v[j]
        return np.bincount(i, d, len(v)) - np.bincount(j, d, len(v))

    total = lambda v: np.bincount(g, v, n)
    known = np.where(hole, 0.0, h[order])
    bound = np.bincount(g[~hole], minlength=n) > 0
    middle = np.divide(total(known), np.maximum(np.bincount(g[~hole], minlength=n), 1))
    u = np.where(hole, middle[g], known)
    r = np.where(hole, -laplace(u), 0.0)
    p, rr = r.copy(), total(r * r)
    scale = np.maximum(total(np.where(hole, 0.0, known - middle[g]) ** 2), 1e-300)
    for _ in range(4 * int(np.bincount(g[hole], minlength=1).max(initial=0)) + 50):
        if not (rr > tol * tol * scale).any():
            break
        ap = np.where(hole, laplace(p), 0.0)
        pap = total(p * ap)
        step = np.divide(rr, pap, out=np.zeros(n), where=pap > 0)
        u += step[g] * p
        r -= step[g] * ap
        new = total(r * r)
        p = r + np.divide(new, rr, out=np.zeros(n), where=rr > 0)[g] * p
        rr = new
    out = np.empty(len(h))
    out[order] = np.where(hole & ~bound[g], np.nan, u)
    return out
