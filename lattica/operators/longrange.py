"""Smooth particle-mesh sums: charges spread to a grid by B-splines, convolved by FFT, energies and forces read back.

No task holds the grid, whose size follows the box and kappa (mesh). It is cut into slabs of planes across x: charges are
dealt to the slabs that they touch and each plane is transformed along y and z; the planes' rows are dealt by ky, so that a
task has a block of them for every x, transforms it along x, multiplies by the kernel and goes back the same way. Slabs and
blocks are of about HELD points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.schema import COULOMB, Box

ORDER = 4
#: Largest spacing of the grid, times kappa.
SPACING = 0.3
#: Points of a slab or a block, about; slabs at least, if the grid has as many planes; charges looked at in one go.
HELD, SLABS, CHUNK = 1 << 22, 16, 1 << 14
#: A part of a transformed plane: its block of rows, its place along x, and the rows as complex doubles.
PART = "r int, gx int, v binary"


def mesh(box: Box, kappa: float) -> int:
    """Points along an axis, so that none is spaced wider than SPACING / kappa; a product of 2, 3 and 5, for the FFT."""
    n = max(2 * ORDER, math.ceil(max(box.dim) * kappa / SPACING))
    while 30**30 % n:
        n += 1
    return n


def spline(u: Column) -> Column:
    """Cardinal B-spline of order four, on (0, 4)."""
    p1 = u * u * u / 6.0
    p2 = (((-3.0 * u + 12.0) * u - 12.0) * u + 4.0) / 6.0
    p3 = (((3.0 * u - 24.0) * u + 60.0) * u - 44.0) / 6.0
    p4 = (4.0 - u) * (4.0 - u) * (4.0 - u) / 6.0
    return F.when((u <= 0) | (u >= 4), 0.0).when(u < 1, p1).when(u < 2, p2).when(u < 3, p3).otherwise(p4)


def slope(u: Column) -> Column:
    """The derivative of spline()."""
    p1 = u * u / 2.0
    p2 = ((-9.0 * u + 24.0) * u - 12.0) / 6.0
    p3 = ((9.0 * u - 48.0) * u + 60.0) / 6.0
    p4 = -(4.0 - u) * (4.0 - u) / 2.0
    return F.when((u <= 0) | (u >= 4), 0.0).when(u < 1, p1).when(u < 2, p2).when(u < 3, p3).otherwise(p4)


def cardinal(u: np.ndarray, order: int) -> np.ndarray:
    """Cardinal B-spline of any order by its recursion, for what is computed on the driver."""
    u = np.asarray(u, float)
    if order == 2:
        return np.maximum(0.0, 1.0 - np.abs(u - 1.0))
    return (u * cardinal(u, order - 1) + (order - u) * cardinal(u - 1.0, order - 1)) / (order - 1)


def near_points(ps: DataFrame, box: Box, grid: int) -> DataFrame:
    """Each charge once for each of its 4^3 grid points: id, q, gx, gy, gz, with the weight w and its derivatives wx, wy,
    wz by position."""
    rows = ps.select("id", "q", *[((F.col(c) - F.lit(o)) * F.lit(grid / d)).alias(f"u{c}") for c, o, d in zip("xyz", box.origin, box.dim, strict=True)])
    for c in "xyz":
        base = F.floor(F.col(f"u{c}"))
        at = [F.col(f"u{c}") - base + float(k) for k in range(ORDER)]
        near = F.array(*[F.struct(F.pmod(base - k, F.lit(grid)).cast("int").alias("g"), spline(u).alias("w"), slope(u).alias("d")) for k, u in enumerate(at)])
        rows = rows.withColumn(f"g{c}", F.explode(near))
    w = {c: F.col(f"g{c}.w") for c in "xyz"}
    d = {c: F.col(f"g{c}.d") * F.lit(grid / edge) for c, edge in zip("xyz", box.dim, strict=True)}
    return rows.select(
        "id", "q", *[F.col(f"g{c}.g").alias(f"g{c}") for c in "xyz"], (w["x"] * w["y"] * w["z"]).alias("w"),
        (d["x"] * w["y"] * w["z"]).alias("wx"), (w["x"] * d["y"] * w["z"]).alias("wy"), (w["x"] * w["y"] * d["z"]).alias("wz"),
    )


def spread(ps: DataFrame, box: Box, grid: int) -> DataFrame:
    """(gx, gy, gz, q): each charge on its 4^3 grid points."""
    points = near_points(ps, box, grid)
    return points.groupBy("gx", "gy", "gz").agg(F.sum(F.col("q") * F.col("w")).alias("q"))


def forces(ps: DataFrame, grid_phi: DataFrame, box: Box, grid: int) -> DataFrame:
    """(id, fx, fy, fz): minus the gradient of energy(), as the potential on the grid gives it back to the charges."""
    met = near_points(ps, box, grid).join(grid_phi.select("gx", "gy", "gz", "phi"), ["gx", "gy", "gz"])
    return met.groupBy("id").agg(*[F.sum(-F.col("q") * F.col("phi") * F.col(f"w{c}")).alias(f"f{c}") for c in "xyz"])


def influence(box: Box, grid: int, kappa: float, rows: slice = slice(None)) -> np.ndarray:
    """Theta(m): the reciprocal kernel with the splines' factors, for the half that rfftn gives; 0 at the origin. rows are
    those along the second axis that are wanted."""
    m = np.fft.fftfreq(grid, 1.0 / grid)
    k = np.arange(ORDER - 1)
    at = cardinal(np.arange(1.0, ORDER), ORDER)
    den = (at * np.exp(2j * np.pi * np.outer(m, k) / grid)).sum(axis=1)
    b = 1.0 / np.abs(den) ** 2
    half = grid // 2 + 1
    fx, fy, fz = ((m / d) ** 2 for d in box.dim)
    f2 = fx[:, None, None] + fy[None, rows, None] + fz[None, None, :half]
    with np.errstate(divide="ignore", invalid="ignore"):
        kernel = np.exp(-(np.pi**2) * f2 / kappa**2) / f2
    kernel[f2 == 0.0] = 0.0
    return kernel * b[:, None, None] * b[None, rows, None] * b[None, None, :half]


def thickness(grid: int) -> int:
    """Planes of a slab, and rows of a block."""
    return max(1, min(math.ceil(grid / SLABS), HELD // grid**2))


def _factor(box: Box) -> float:
    return COULOMB / (math.pi * math.prod(box.dim))


def _base(box: Box, grid: int) -> Column:
    """A charge's last plane; it touches ORDER of them."""
    return F.floor((F.col("x") - F.lit(box.origin[0])) * F.lit(grid / box.dim[0]))


def _slabs(first: Column, sign: int, grid: int) -> Column:
    """The slabs of ORDER planes from first on, up or down, each once."""
    planes = F.array(*[F.floor(F.pmod(first + sign * k, F.lit(grid)) / thickness(grid)).cast("int") for k in range(ORDER)])
    return F.explode(F.array_distinct(planes))


def _points(t: pa.Table, box: Box, grid: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """By axis: the ORDER grid points of each charge, their weights and the weights' derivatives by position."""
    at, w, d = [], [], []
    for c, o, edge in zip("xyz", box.origin, box.dim, strict=True):
        u = (t.column(c).to_numpy() - o) * (grid / edge)
        k = np.arange(ORDER)
        base = np.floor(u)[:, None]
        near = u[:, None] - base + k
        at.append((base.astype(np.int64) - k) % grid)
        w.append(cardinal(near, ORDER))
        d.append((cardinal(near, ORDER - 1) - cardinal(near - 1.0, ORDER - 1)) * (grid / edge))
    return at, w, d


def _transformed(dealt: DataFrame, grid: int, add: Callable[[np.ndarray, int, pa.Table], None]) -> DataFrame:
    """PART of the planes, transformed along y and z. dealt are rows by slab s, which add puts on the slab's planes, of
    which it is told the first."""
    thick = thickness(grid)

    def run(t: pa.Table) -> pa.Table:
        first = t.column("s")[0].as_py() * thick
        q = np.zeros((min(thick, grid - first), grid, grid))
        for lo in range(0, t.num_rows, CHUNK):
            add(q, first, t.slice(lo, CHUNK))
        cuts = range(0, grid, thick)
        parts = [f[lo : lo + thick].tobytes() for f in map(np.fft.rfft2, q) for lo in cuts]
        planes = range(first, first + len(q))
        return pa.table({"r": pa.array([r for _ in planes for r in range(len(cuts))], pa.int32()), "gx": pa.array([g for g in planes for _ in cuts], pa.int32()), "v": pa.array(parts, pa.binary())})

    return dealt.groupBy("s").applyInArrow(run, PART)


def transformed(ps: DataFrame, box: Box, grid: int) -> DataFrame:
    """PART of the charges' planes. A charge is dealt to every slab that it touches; one without a place has none."""
    rows = ps.select(F.col("q").cast("double").alias("q"), "x", "y", "z").dropna()

    def add(q: np.ndarray, first: int, t: pa.Table) -> None:
        (gx, gy, gz), (wx, wy, wz), _ = _points(t, box, grid)
        yz = (gy[:, :, None] * grid + gz[:, None, :]).reshape(-1, ORDER**2)
        w = (wy[:, :, None] * wz[:, None, :]).reshape(-1, ORDER**2) * t.column("q").to_numpy()[:, None]
        for k in range(ORDER):
            at = np.flatnonzero((gx[:, k] >= first) & (gx[:, k] < first + len(q)))
            np.add.at(q.reshape(-1), ((gx[at, k] - first)[:, None] * grid**2 + yz[at]).ravel(), (wx[at, k][:, None] * w[at]).ravel())

    return _transformed(rows.select(_slabs(_base(box, grid), -1, grid).alias("s"), "q", "x", "y", "z"), grid, add)


def _block(t: pa.Table, grid: int) -> tuple[np.ndarray, slice]:
    """A block of rows for every x, transformed along x, and which rows they are. Planes without charges are left out of t."""
    thick = thickness(grid)
    lo = t.column("r")[0].as_py() * thick
    rows = slice(lo, min(lo + thick, grid))
    out = np.zeros((grid, rows.stop - lo, grid // 2 + 1), complex)
    for gx, v in zip(t.column("gx").to_pylist(), t.column("v"), strict=True):
        out[gx] = np.frombuffer(v.as_buffer(), complex).reshape(out.shape[1:])
    return np.fft.fft(out, axis=0), rows


def mesh_energy(parts: DataFrame, box: Box, grid: int, kappa: float) -> DataFrame:
    """(e): half the charges times the potential, summed over the modes, so that nothing is transformed back."""
    factor = 0.5 * _factor(box)

    def run(t: pa.Table) -> pa.Table:
        f, rows = _block(t, grid)
        twice = np.full(grid // 2 + 1, 2.0)  # the half that rfft leaves out
        twice[0] = 1.0
        if grid % 2 == 0:
            twice[-1] = 1.0
        f = (f.real**2 + f.imag**2) * influence(box, grid, kappa, rows)
        return pa.table({"e": [factor * float((f.sum(axis=(0, 1)) * twice).sum())]})

    return parts.groupBy("r").applyInArrow(run, "e double").agg(F.sum("e").alias("e"))


def potential(parts: DataFrame, box: Box, grid: int, kappa: float) -> DataFrame:
    """PART of the potential's planes, for all planes: only y and z are left to be transformed back."""

    def run(t: pa.Table) -> pa.Table:
        f, rows = _block(t, grid)
        f *= influence(box, grid, kappa, rows)
        f = np.fft.ifft(f, axis=0) * (grid**3 * _factor(box))
        return pa.table({"r": pa.array([t.column("r")[0].as_py()] * grid, pa.int32()), "gx": pa.array(range(grid), pa.int32()), "v": pa.array([x.tobytes() for x in f], pa.binary())})

    return parts.groupBy("r").applyInArrow(run, PART)


def _planes(t: pa.Table, grid: int) -> dict[int, np.ndarray]:
    """Whole planes of the potential, by their place."""
    thick = thickness(grid)
    f: dict[int, np.ndarray] = {}
    for r, gx, v in zip(t.column("r").to_pylist(), t.column("gx").to_pylist(), t.column("v"), strict=True):
        plane = f.setdefault(gx, np.empty((grid, grid // 2 + 1), complex))
        plane[r * thick : (r + 1) * thick] = np.frombuffer(v.as_buffer(), complex).reshape(-1, grid // 2 + 1)
    return {gx: np.fft.irfft2(plane, (grid, grid), (0, 1)) for gx, plane in f.items()}


def mesh_forces(ps: DataFrame, parts: DataFrame, box: Box, grid: int) -> DataFrame:
    """(id, fx, fy, fz): minus the gradient of mesh_energy(), from the PART that potential() gives. Charges are dealt to the
    slab of their last plane, planes to every slab whose charges touch them."""
    slab = F.floor(F.pmod(_base(box, grid), F.lit(grid)) / thickness(grid)).cast("int").alias("s")
    rows = ps.dropna(subset=["x", "y", "z"]).select(slab, "id", F.col("q").cast("double").alias("q"), "x", "y", "z")
    near = parts.select(_slabs(F.col("gx"), 1, grid).alias("s"), "r", "gx", "v")

    def run(t: pa.Table, p: pa.Table) -> pa.Table:
        out = np.zeros((t.num_rows, 3))
        if t.num_rows and p.num_rows:
            found = _planes(p, grid)
            own = np.zeros(grid, np.int64)
            own[list(found)] = np.arange(len(found))
            phi = np.stack(list(found.values())).reshape(-1)
            del found
            for lo in range(0, t.num_rows, CHUNK):
                (gx, gy, gz), (wx, wy, wz), (dx, dy, dz) = _points(t.slice(lo, CHUNK), box, grid)
                yz = gy[:, :, None] * grid + gz[:, None, :]
                for k in range(ORDER):
                    v = phi[(own[gx[:, k]] * grid**2)[:, None, None] + yz]
                    for c, (x, y, z) in enumerate(((dx, wy, wz), (wx, dy, wz), (wx, wy, dz))):
                        out[lo : lo + CHUNK, c] += x[:, k] * np.einsum("nyz,ny,nz->n", v, y, z)
        return pa.table({"id": t.column("id"), "q": t.column("q"), **{f"g{c}": out[:, k] for k, c in enumerate("xyz")}})

    met = rows.groupBy("s").cogroup(near.groupBy("s")).applyInArrow(run, f"id {ps.schema['id'].dataType.simpleString()}, q double, gx double, gy double, gz double")
    return met.select("id", *[(-F.col("q") * F.col(f"g{c}")).alias(f"f{c}") for c in "xyz"])


def convolved(grid_q: DataFrame, box: Box, grid: int, kappa: float) -> DataFrame:
    """(gx, gy, gz, q, phi): the potential on all points of the grid, as rows. grid_q is read twice."""
    thick = thickness(grid)
    rows = grid_q.select(F.floor(F.col("gx") / thick).cast("int").alias("s"), "gx", "gy", "gz", F.col("q").cast("double").alias("q"))

    def add(q: np.ndarray, first: int, t: pa.Table) -> None:
        np.add.at(q, (t.column("gx").to_numpy() - first, t.column("gy").to_numpy(), t.column("gz").to_numpy()), t.column("q").to_numpy())

    def run(t: pa.Table, p: pa.Table) -> pa.Table:
        found = _planes(p, grid)
        first = min(found)
        q = np.zeros((len(found), grid, grid))
        add(q, first, t)
        gx, gy, gz = (i.ravel().astype(np.int32) for i in np.indices(q.shape, np.int32))
        return pa.table({"gx": gx + np.int32(first), "gy": gy, "gz": gz, "q": q.ravel(), "phi": np.stack([found[g] for g in sorted(found)]).ravel()})

    parts = potential(_transformed(rows, grid, add), box, grid, kappa).select(F.floor(F.col("gx") / thick).cast("int").alias("s"), "r", "gx", "v")
    return rows.groupBy("s").cogroup(parts.groupBy("s")).applyInArrow(run, "gx int, gy int, gz int, q double, phi double")


def energy(grid_phi: DataFrame) -> DataFrame:
    """(e): half the charges times the potential."""
    return grid_phi.agg((0.5 * F.sum(F.col("q") * F.col("phi"))).alias("e"))
