"""Cells, wrapping, minimum image, neighbour cells."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.schema import Box

AXES = ("x", "y", "z")
CELLS = ("cx", "cy", "cz")


def wrap(u: Column, origin: float, edge: float) -> Column:
    return u - F.lit(edge) * F.floor((u - F.lit(origin)) / F.lit(edge))


def wrapped(ps: DataFrame, box: Box) -> DataFrame:
    """Positions moved into the box along its periodic axes."""
    return ps.withColumns({c: wrap(F.col(c), o, d) for c, o, d, p in zip(AXES, box.origin, box.dim, box.periodic, strict=True) if p})


def inside(ps: DataFrame, box: Box) -> DataFrame:
    """Rows within the box; what lies outside is left out, also just below the origin."""
    ok = F.lit(True)
    for c, o, d in zip(AXES, box.origin, box.dim, strict=True):
        ok &= (F.col(c) >= o) & (F.col(c) < o + d)
    return ps.where(ok)


def binned(ps: DataFrame, box: Box) -> DataFrame:
    """Adds cx, cy, cz and cell = (cx * ny + cy) * nz + cz."""
    at = {c: F.least(F.floor((F.col(a) - F.lit(o)) / F.lit(h)), F.lit(n - 1)).cast("int") for c, a, o, h, n in zip(CELLS, AXES, box.origin, box.width, box.cells, strict=True)}
    _, ny, nz = box.cells
    return ps.withColumns(at).withColumn("cell", ((F.col("cx") * ny + F.col("cy")) * nz + F.col("cz")).cast("long"))


def image(d: Column, edge: float) -> Column:
    """Minimum image of a difference."""
    return d - F.lit(edge) * F.floor(d / F.lit(edge) + 0.5)


def differences(a: str, b: str, box: Box) -> list[Column]:
    """Minimum-image components of a - b for two aliases."""
    raw = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in AXES]
    return [image(d, e) if p else d for d, e, p in zip(raw, box.dim, box.periodic, strict=True)]


def half_shell(box: Box) -> list[tuple[int, int, int]]:
    """Offsets to the neighbour cells that hold partners, own cell first, of each opposite pair one; cells whose nearest
    corners are beyond the cutoff are left out."""
    out = [(0, 0, 0)]
    for off in product(*[range(-s, s + 1) for s in box.span]):
        near = sum((max(0, abs(o) - 1) * h) ** 2 for o, h in zip(off, box.width, strict=True))
        if off > (0, 0, 0) and near <= box.cutoff**2:
            out.append(off)
    return out


def cell_pairs(ps: DataFrame, box: Box) -> DataFrame:
    """(cell_a, cell_b), a <= b: pairs of cells that can hold partners, each once."""
    nx, ny, nz = box.cells
    cells = ps.sparkSession.range(nx * ny * nz).select(F.floor(F.col("id") / (ny * nz)).alias("cx"), F.floor(F.col("id") / nz) % ny, F.col("id") % nz, F.col("id").alias("cell")).toDF(*CELLS, "cell")
    moved = _neighbours(cells, box).select("cell", ((F.col("nx") * ny + F.col("ny")) * nz + F.col("nz")).alias("other"))
    return moved.select(F.least("cell", "other").alias("cell_a"), F.greatest("cell", "other").alias("cell_b")).distinct()


def _neighbours(binned_ps: DataFrame, box: Box) -> DataFrame:
    """Each row once per neighbour cell nx, ny, nz; own says that it is the row's own cell."""
    shell = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abc", off, strict=True)], F.lit(off == (0, 0, 0)).alias("own")) for off in half_shell(box)])
    rows = binned_ps.withColumn("_o", F.explode(shell))
    for c, k, name, n, p in zip(CELLS, "abc", ("nx", "ny", "nz"), box.cells, box.periodic, strict=True):
        moved = F.col(c) + F.col(f"_o.{k}")
        rows = rows.withColumn(name, F.pmod(moved, F.lit(n)) if p else moved)
    return rows.withColumn("own", F.col("_o.own")).drop("_o")
