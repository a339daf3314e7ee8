"""Potentials as tables: any energy function becomes piecewise quintics in r, fitted on the driver, evaluated in plans.

The nodes are denser where the curve bends more (by the cube root of its second derivative) and their number doubles
until the error is within the tolerance. Each piece matches value, slope and curvature at both ends, so the table is C2.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.potentials import Term

MOST = 4096


@dataclass(frozen=True)
class Table:
    """Pieces c0..c5 in t in [-1, 1] on the intervals of nodes; the index of r is that of a uniform map."""

    a: float
    b: float
    nodes: np.ndarray
    coeffs: np.ndarray
    error: float

    def value(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Energies and slopes dE/dr; below a the first piece goes on."""
        r = np.asarray(r, float)
        i = np.clip(np.searchsorted(self.nodes, r, side="right") - 1, 0, len(self.coeffs) - 1)
        half = 0.5 * np.diff(self.nodes)[i]
        t = (r - self.nodes[i]) / half - 1.0
        c = self.coeffs[i].T
        e = c[0] + t * (c[1] + t * (c[2] + t * (c[3] + t * (c[4] + t * c[5]))))
        d = (c[1] + t * (2 * c[2] + t * (3 * c[3] + t * (4 * c[4] + t * 5 * c[5])))) / half
        return e, d


def _derivative(f: Callable[[np.ndarray], np.ndarray], r: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Central difference of order six."""
    return (45 * (f(r + h) - f(r - h)) - 9 * (f(r + 2 * h) - f(r - 2 * h)) + (f(r + 3 * h) - f(r - 3 * h))) / (60 * h)


def fitted(f: Callable[[np.ndarray], np.ndarray], a: float, b: float, tol: float = 1e-4, df: Callable[[np.ndarray], np.ndarray] | None = None) -> Table:
    """The table of f on [a, b]; tol is relative to max(|f|, 1). f takes and gives arrays."""
    df = df or (lambda r: _derivative(f, r, 1e-4 * r))
    # node density from how fast a piece's error grows: differences of f on a fine grid
    grid = np.linspace(a, b, 2049)
    bend = np.abs(np.gradient(np.gradient(f(grid), grid), grid)) ** (1 / 3) + 1e-9
    bend = bend / bend.mean() + 0.05
    level = np.r_[0.0, np.cumsum(0.5 * (bend[1:] + bend[:-1]))]
    level /= level[-1]
    n = 8
    while True:
        nodes = np.interp(np.linspace(0, 1, n + 1), level, grid)
        nodes[0], nodes[-1] = a, b
        half = 0.5 * np.diff(nodes)
        v, d = f(nodes), df(nodes)
        k = _derivative(df, nodes, 1e-4 * nodes)
        y = np.stack([v[:-1], v[1:], d[:-1] * half, d[1:] * half, k[:-1] * half**2, k[1:] * half**2])
        t = np.array([-1.0, 1.0])
        rows = [t**0 * 1, *[t**p for p in range(1, 6)]]
        m = np.concatenate([np.stack(rows, 1), np.stack([0 * t, *[p * t ** (p - 1) for p in range(1, 6)]], 1), np.stack([0 * t, 0 * t, *[p * (p - 1) * t ** (p - 2) for p in range(2, 6)]], 1)])
        table = Table(a, b, nodes, np.linalg.solve(m, y).T, 0.0)
        at = (nodes[:-1, None] + np.diff(nodes)[:, None] * np.linspace(0.02, 0.98, 13)).ravel()
        error = float(np.max(np.abs(table.value(at)[0] - f(at)) / np.maximum(np.abs(f(at)), 1.0)))
        if error <= tol:
            return Table(a, b, nodes, table.coeffs, error)
        if n >= MOST:
            raise ValueError(f"no table of {MOST} pieces is within {tol}; the error is {error}")
        n *= 2


def frame(spark: SparkSession, tables: dict[int, Table]) -> DataFrame:
    """(pot_id, ind, lo, hi, c0..c5): a row per piece; tables have MOST pieces at most each."""
    rows = [(p, i, float(t.nodes[i]), float(t.nodes[i + 1]), *map(float, c)) for p, t in tables.items() for i, c in enumerate(t.coeffs)]
    return spark.createDataFrame(rows, "pot_id int, ind int, lo double, hi double, c0 double, c1 double, c2 double, c3 double, c4 double, c5 double")


#: Slots of the uniform index of a table, at most.
SLOTS = 1 << 14


def slots(spark: SparkSession, table: Table) -> DataFrame:
    """(slot, piece): the pieces that a slot of a uniform index over the domain touches, each with lo, half and c0..c5."""
    n = min(SLOTS, 4 * len(table.coeffs))
    edges = table.a + (table.b - table.a) * np.arange(n + 1) / n
    first = np.clip(np.searchsorted(table.nodes, edges[:-1], side="right") - 1, 0, len(table.coeffs) - 1)
    last = np.clip(np.searchsorted(table.nodes, edges[1:], side="left") - 1, 0, len(table.coeffs) - 1)
    half = 0.5 * np.diff(table.nodes)
    piece = lambda k: (float(table.nodes[k]), float(half[k]), *map(float, table.coeffs[k]))
    rows = [(s, [piece(k) for k in range(a, b + 1)]) for s, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True))]
    return spark.createDataFrame(rows, "slot int, pieces array<struct<lo:double,half:double,c0:double,c1:double,c2:double,c3:double,c4:double,c5:double>>")


def evaluated(rows: DataFrame, table: Table, r2: str = "r2") -> DataFrame:
    """rows with e and f = (dE/dr) / r from a table: an equi-join on the slot of r with SLOTS small rows at most, which
    go to every task, then the last of the slot's pieces that starts at r or before."""
    index = slots(rows.sparkSession, table)
    n = min(SLOTS, 4 * len(table.coeffs))
    r = F.col("_r")
    slot = F.least(F.greatest(F.floor((r - table.a) * (n / (table.b - table.a))), F.lit(0)), F.lit(n - 1)).cast("int")
    met = rows.withColumn("_r", F.sqrt(F.col(r2))).withColumn("slot", slot).join(F.broadcast(index.withColumnRenamed("slot", "_slot")), F.col("slot") == F.col("_slot"))
    more = F.size(F.filter("pieces", lambda p: p["lo"] <= F.col("_r")))
    found = met.withColumn("_p", F.when(F.size("pieces") == 1, F.get("pieces", F.lit(0))).otherwise(F.get("pieces", F.greatest(more - 1, F.lit(0)))))
    found = found.withColumn("_t", (r - F.col("_p.lo")) / F.col("_p.half") - 1.0)
    t, c = F.col("_t"), [F.col(f"_p.c{k}") for k in range(6)]
    e: Column = c[5]
    for k in (4, 3, 2, 1, 0):
        e = c[k] + t * e
    d: Column = 5.0 * c[5]
    for k in (4, 3, 2, 1):
        d = float(k) * c[k] + t * d
    return found.withColumns({"e": e, "f": d / F.col("_p.half") / r}).drop("_r", "slot", "_slot", "pieces", "_p", "_t")
