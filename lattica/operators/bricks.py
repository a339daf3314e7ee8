"""Pairs of a state kept by bricks of the box, as places in a brick instead of ids.

A brick holds its own particles and copies of those around it that are within reach; a copy goes to one of the two bricks
of a pair only, so each pair is in one. A brick's pairs are runs of differences between places, compressed: less than a byte
a pair. A later state sends its particles to the bricks where they were when the list was made, which the columns HOME of a
particle tell, so neither pairs nor what they exert is shuffled: a brick sums the forces on each of its particles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.potentials import Term
from lattica.operators.binning import AXES, image, wrap
from lattica.schema import Box

#: Where a particle was when the list was made.
HOME = ("hx", "hy", "hz")
#: Particles of a brick, about; candidates and pairs that are looked at in one go.
HELD, CANDIDATES, PAIRS = 16_000, 1 << 18, 1 << 16
LIST = "brick int, own int, size int, ranks binary, numbers binary, places binary"
#: Columns of a particle that a brick reads, and in which order.
ENTRY = ("brick", "mine", "turn", "id", "type", "q", "ux", "uy", "uz")


def homed(ps: DataFrame, box: Box) -> DataFrame:
    """ps with HOME, its places now."""
    return ps.withColumns({h: wrap(F.col(c), o, d) if p else F.col(c) for h, c, o, d, p in zip(HOME, AXES, box.origin, box.dim, box.periodic, strict=True)})


def counts(n: int, box: Box, reach: float) -> tuple[int, int, int]:
    """Bricks along each axis, of HELD of n particles and no narrower than reach."""
    for d, p in zip(box.dim, box.periodic, strict=True):
        if p and d <= 2.001 * reach:
            raise ValueError("a periodic axis has to be longer than twice the reach of the list")
    edge = (math.prod(box.dim) * HELD / max(n, 1)) ** (1 / 3)
    return tuple(max(1, min(math.floor(d / (1.001 * reach)), round(d / edge))) for d in box.dim)  # type: ignore[return-value]


def entries(ps: DataFrame, box: Box, reach: float, bricks: tuple[int, int, int], *more: str) -> DataFrame:
    """Each particle (id, type, q, x, y, z, HOME) once for each brick that holds it: ENTRY and more. mine says that it is the
    brick's own; u is its place as the brick sees it, without jumps where the box ends, and turn which image it is."""
    rows = ps.select("id", "type", "q", *AXES, *HOME, *more)
    gap, own, target, turns, mine = F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), F.lit(True)
    later = F.lit(False)
    for c, h, o, d, n, p in zip(AXES, HOME, box.origin, box.dim, bricks, box.periodic, strict=True):
        width = d / n
        b, off = F.col(f"_b{c}"), F.col(f"_o{c}")
        rows = rows.withColumn(f"_b{c}", F.least(F.greatest(F.floor((F.col(h) - F.lit(o)) / F.lit(width)), F.lit(0)), F.lit(n - 1)).cast("int"))
        rows = rows.withColumn(f"_o{c}", F.explode(F.array(*[F.lit(v) for v in ((-1, 0, 1) if p or n > 1 else (0,))])))
        low = F.lit(o) + b * F.lit(width)
        rows = rows.withColumn(f"_g{c}", F.when(off == 0, 0.0).when(off == 1, F.greatest(low + F.lit(width) - F.col(h), F.lit(0.0))).otherwise(F.greatest(F.col(h) - low, F.lit(0.0))))
        rows = rows.where(F.col(f"_g{c}") <= F.lit(1.0001 * reach))
        if not p:
            rows = rows.where((b + off >= 0) & (b + off < n))
        rows = rows.withColumn(f"_s{c}", F.floor((b + off) / F.lit(n)).cast("int"))
        turn = F.col(f"_s{c}")
        way = F.col(c) - F.col(h)
        rows = rows.withColumn(f"u{c}", F.col(h) + (image(way, d) if p else way) - turn * F.lit(d))
        gap, mine = gap + F.col(f"_g{c}") * F.col(f"_g{c}"), mine & (off == 0)
        own, target, turns = own * n + b, target * n + F.pmod(b + off, F.lit(n)), turns * 3 + turn + 1
    for c in reversed(AXES):
        later = (F.col(f"_s{c}") > 0) | ((F.col(f"_s{c}") == 0) & later)
    rows = rows.where(gap <= F.lit((1.0001 * reach) ** 2)).where(mine | (target < own) | ((target == own) & later))
    return rows.select(target.cast("int").alias("brick"), mine.alias("mine"), turns.cast("int").alias("turn"), "id", "type", "q", "ux", "uy", "uz", *more)


def packed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def place(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    """The entries of a brick, by id and turn."""
    col = {k: t.column(k).to_numpy() for k in ENTRY[1:]}
    rank = np.lexsort((col["turn"], col["id"]))
    return {k: v[rank] for k, v in col.items()} | {"_rank": rank}


def _found(at: np.ndarray, own: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, places): of each of the first own places, how many partners are within reach and, in ascending order, which.
    at (n, 3) is sorted by column along z and z, the first own and the others each. Partners of own places come after them."""
    g, n = reach / 2, len(at)
    low = at.min(axis=0)
    cell = np.floor((at[:, :2] - low[:2]) / g).astype(np.int64)
    nx, ny = cell.max(axis=0) + 1
    tall = at[:, 2].max() - low[2] + 2 * reach + 1
    up = at[:, 2] - low[2] + reach
    key = (cell[:, 0] * ny + cell[:, 1]) * tall + up
    near = []
    for first, last in ((0, own), (own, n)):
        for ox in range(-2, 3):
            for oy in range(-2, 3):
                if first == 0 and (ox, oy) < (0, 0):
                    continue
                cx, cy = cell[:own, 0] + ox, cell[:own, 1] + oy
                h2 = np.full(own, reach * reach)
                for k, c in ((0, cx), (1, cy)):
                    side = low[k] + c * g
                    h2 -= np.maximum(0.0, np.maximum(side - at[:own, k], at[:own, k] - side - g)) ** 2
                who = np.flatnonzero((h2 > -1e-9) & (cx >= 0) & (cx < nx) & (cy >= 0) & (cy < ny))
                h = np.sqrt(np.maximum(h2[who], 0.0)) + 1e-6
                mid = (cx[who] * ny + cy[who]) * tall + up[who]
                lo, hi = np.zeros(own, np.int64), np.zeros(own, np.int64)
                lo[who] = first + np.searchsorted(key[first:last], mid - h)
                hi[who] = first + np.searchsorted(key[first:last], mid + h, "right")
                if first == 0 and (ox, oy) == (0, 0):
                    lo = np.maximum(lo, np.arange(own) + 1)
                near.append((lo, np.maximum(hi - lo, 0)))
    starts, lens = (np.stack(x, axis=1) for x in zip(*near, strict=True))
    each = lens.sum(axis=1)
    upto = np.cumsum(each)
    x, y, z = (np.ascontiguousarray(at[:, k]) for k in range(3))
    numbers, places, a = np.zeros(own, np.int64), [], 0
    while a < own:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CANDIDATES)))
        n_, s_ = lens[a:b].ravel(), starts[a:b].ravel()
        j = np.repeat(s_ - (np.cumsum(n_) - n_), n_) + np.arange(n_.sum())
        w = each[a:b]
        r2 = (np.repeat(x[a:b], w) - x[j]) ** 2 + (np.repeat(y[a:b], w) - y[j]) ** 2 + (np.repeat(z[a:b], w) - z[j]) ** 2
        hit = np.flatnonzero(r2 <= reach * reach)
        numbers[a:b] = np.bincount(np.repeat(np.arange(b - a), w)[hit], minlength=b - a)
        places.append(j[hit].astype(np.int32))
        a = b
    return numbers, np.concatenate(places) if places else np.zeros(0, np.int32)


def _without(col: dict[str, np.ndarray], out: pa.ChunkedArray, to: np.ndarray, numbers: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same less the pairs of particles whose ids exclude each other; out has, by entry, the partners it excludes."""
    lists = out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out
    flat, parent = lists.flatten().to_numpy(), pa.compute.list_parent_indices(lists).to_numpy()
    first, last = np.searchsorted(col["id"], flat), np.searchsorted(col["id"], flat, "right")
    n = last - first
    a = np.repeat(parent, n)
    b = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    a, b = to[a], to[b]
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    size = len(col["id"])
    rows = np.repeat(np.arange(len(numbers)), numbers)
    keys, gone = rows * size + places, lo * size + hi
    at = np.searchsorted(keys, gone)
    at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == gone)] if len(keys) else at[:0]
    stay = np.ones(len(keys), bool)
    stay[at] = False
    return np.bincount(rows[stay], minlength=len(numbers)), places[stay]


def listed(rows: DataFrame, reach: float) -> DataFrame:
    """LIST: the pairs within reach of each brick of entries(). With a column out, pairs with ids in it are left out."""
    excluding = "out" in rows.columns

    def make(t: pa.Table) -> pa.Table:
        col = _columns(t)
        at, mine = np.stack([col[c] for c in ENTRY[-3:]], axis=1), col["mine"].astype(bool)
        low, own = at.min(axis=0), int(mine.sum())
        cell = np.floor((at[:, :2] - low[:2]) / (reach / 2)).astype(np.int64)
        order = np.lexsort((at[:, 2], cell[:, 1], cell[:, 0], ~mine))
        numbers, places = _found(at[order], own, reach) if own else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        if excluding and own:
            to = np.empty(len(order), np.int64)
            to[order] = np.arange(len(order))
            numbers, places = _without(col, t.column("out").combine_chunks().take(pa.array(col["_rank"])), to, numbers, places)
        kind = place(len(order))
        steps = np.diff(places.astype(kind), prepend=kind(0))
        data = [[t.column("brick")[0].as_py()], [own], [len(order)], [packed(order.astype(np.uint32))], [packed(numbers.astype(np.uint32))], [packed(steps)]]
        return pa.table([pa.array(v, k) for v, k in zip(data, (*[pa.int32()] * 3, *[pa.binary()] * 3), strict=True)], names=["brick", "own", "size", "ranks", "numbers", "places"])

    return rows.groupBy("brick").applyInArrow(make, LIST)


def _near(now: pa.Table, kept: pa.Table, cutoff: float) -> tuple[dict[str, np.ndarray], Iterator[tuple[np.ndarray, ...]]]:
    """The entries of a brick in its list's order, and its pairs within the cutoff now, some at a time: (i, j, dx, dy, dz, r2)."""
    col = _columns(now)
    own, size, ranks, numbers, places = (kept.column(k)[0].as_py() for k in ("own", "size", "ranks", "numbers", "places"))
    if size != len(col["id"]):
        raise ValueError("a state has other particles than the list of its pairs")
    order = unpacked(ranks, size, np.uint32)
    col = {k: v[order] for k, v in col.items() if k != "_rank"}
    numbers = unpacked(numbers, own, np.uint32).astype(np.int64)
    upto = np.cumsum(numbers)
    total = int(upto[-1]) if own else 0
    kind = place(size)
    partners = np.cumsum(unpacked(places, total, kind), dtype=kind)

    def chunks() -> Iterator[tuple[np.ndarray, ...]]:
        x, y, z = (col[c] for c in ENTRY[-3:])
        a = 0
        while a < own:
            start = int(upto[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(upto, start + PAIRS)))
            w = numbers[a:b]
            j = partners[start : int(upto[b - 1])].astype(np.int64)
            dx, dy, dz = (np.repeat(u[a:b], w) - u[j] for u in (x, y, z))
            r2 = dx * dx + dy * dy + dz * dz
            hit = np.flatnonzero(r2 <= cutoff * cutoff)
            yield np.repeat(np.arange(a, b), w)[hit], j[hit], dx[hit], dy[hit], dz[hit], r2[hit]
            a = b

    return col, chunks()


def met(rows: DataFrame, lists: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work on each brick's entries and list; schema and an empty table where one of the two is missing."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    none = pa.table([pa.array([], kinds[c.strip().split(" ")[1]]) for c in schema.split(",")], names=names)

    def both(now: pa.Table, kept: pa.Table) -> pa.Table:
        return work(now, kept) if now.num_rows and kept.num_rows else none

    return rows.groupBy("brick").cogroup(lists.groupBy("brick")).applyInArrow(both, schema)


def pairs(rows: DataFrame, lists: DataFrame, cutoff: float) -> DataFrame:
    """The listed pairs within the cutoff now, a row each, for terms that are column expressions."""
    schema = "i long, j long, type_i int, type_j int, q_i double, q_j double, dx double, dy double, dz double, r2 double"

    def work(now: pa.Table, kept: pa.Table) -> pa.Table:
        col, chunks = _near(now, kept, cutoff)
        parts = [[*[col[c][k] for c in ("id", "type", "q") for k in (i, j)], *d] for i, j, *d in chunks]
        flat = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 10
        return pa.table([pa.array(v.astype(k)) for v, k in zip(flat, (*[np.int64] * 2, *[np.int32] * 2, *[float] * 6), strict=True)], names=[c.split(" ")[0] for c in schema.split(", ")])

    return met(rows, lists, work, schema)


def sums(rows: DataFrame, lists: DataFrame, cutoff: float, pair_pot: pa.Table, kernel: Callable[[Mapping[str, np.ndarray]], Term]) -> DataFrame:
    """(id, fx, fy, fz, e): by brick, the force on each particle and the energy of the pairs whose first end it is. kernel is
    a term that takes arrays by name; types without a potential do not interact."""
    schema = "id long, fx double, fy double, fz double, e double"
    pot = {k: pair_pot.column(k).to_numpy() for k in pair_pot.column_names}
    types = np.unique(np.concatenate([pot["type_i"], pot["type_j"]]))
    row = np.full((len(types) + 1,) * 2, -1)
    row[np.searchsorted(types, pot["type_i"]), np.searchsorted(types, pot["type_j"])] = np.arange(len(pot["type_i"]))

    def work(now: pa.Table, kept: pa.Table) -> pa.Table:
        col, chunks = _near(now, kept, cutoff)
        kind = np.searchsorted(types, col["type"])
        kind[(kind < len(types)) & (types[np.minimum(kind, len(types) - 1)] != col["type"])] = len(types)
        n = len(kind)
        total, touched = np.zeros((4, n)), np.zeros(n, bool)
        for i, j, dx, dy, dz, r2 in chunks:
            at = row[kind[i], kind[j]]
            if at.size and at.min() < 0:
                ok = np.flatnonzero(at >= 0)
                i, j, dx, dy, dz, r2, at = (v[ok] for v in (i, j, dx, dy, dz, r2, at))
            if not len(i):
                continue
            named = {"r2": r2, "dx": dx, "dy": dy, "dz": dz, "q_i": col["q"][i], "q_j": col["q"][j], "type_i": col["type"][i], "type_j": col["type"][j]}
            t = kernel(named | {k: v[at] for k, v in pot.items() if k not in ("type_i", "type_j")})
            a, b = i[0], i[-1] + 1
            for k, d in enumerate((dx, dy, dz)):
                f = t.f * d
                total[k, a:b] -= np.bincount(i - a, f, b - a)
                total[k] += np.bincount(j, f, n)
            total[3, a:b] += np.bincount(i - a, t.e, b - a)
            touched[i], touched[j] = True, True
        return pa.table([pa.array(col["id"][touched]), *[pa.array(v[touched]) for v in total]], names=["id", "fx", "fy", "fz", "e"])

    return met(rows, lists, work, schema)
