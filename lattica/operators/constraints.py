"""Rigid groups: connected components of constraints, SHAKE and its preconditioned form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.state import settled
from lattica.schema import Box

MAX_PARTS = 10
STATE = ("m", "x", "y", "z", "vx", "vy", "vz", "ox", "oy", "oz")


def added(constraints: DataFrame, more: DataFrame) -> DataFrame:
    """Constraints (i, j, d2) with more appended: i < j, a pair given again takes its last distance. A group that grows
    over MAX_PARTS particles is an error, raised when groups() is asked for."""
    rows = constraints.select("i", "j", "d2", F.lit(0).alias("_n")).unionByName(more.select("i", "j", "d2", F.lit(1).alias("_n")))
    return rows.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max_by("d2", "_n").alias("d2"))


def groups(edges: DataFrame, most: int = MAX_PARTS) -> DataFrame:
    """(id, rid): the smallest particle that constraints (i, j) connect it to.

    Each round takes the neighbours' smallest label and then that label's own, and is settled. Groups have most particles
    at most, so rounds are few; labels that don't settle within them, or a larger group, are an error.
    """
    both = settled(edges.select("i", "j").union(edges.select("j", "i")).distinct(), "edges")
    labels = settled(both.groupBy(F.col("i").alias("id")).agg(F.min("j").alias("m")).select("id", F.least("id", "m").alias("rid")), "labels")
    for _ in range(most):
        near = both.join(labels.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(F.min("rid").alias("m"))
        best = labels.join(near, "id").select("id", F.least("rid", "m").alias("rid"), F.col("rid").alias("was"))
        up = labels.select(F.col("id").alias("rid"), F.col("rid").alias("up"))
        new = settled(best.join(up, "rid").select("id", F.least("rid", "up").alias("rid"), "was"), "labels")
        labels = new.select("id", "rid")
        if new.where("rid <> was").isEmpty():
            if not labels.groupBy("rid").count().where(F.col("count") > most).isEmpty():
                break
            return labels
    raise ValueError(f"a rigid group has more than {most} particles")


def grouped(constraints: DataFrame) -> DataFrame:
    """(rid, i, j, d2): constraints with their group."""
    return constraints.join(groups(constraints).withColumnRenamed("id", "i"), "i").select("rid", "i", "j", "d2")


def counted(constraints: DataFrame) -> DataFrame:
    """(constraints, groups, parts): what the degrees of freedom need."""
    of = groups(constraints).agg(F.count_distinct("rid").alias("groups"), F.count("*").alias("parts"))
    return constraints.agg(F.count("*").alias("constraints")).join(of, F.lit(True))


def _near(d: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Minimum image; an edge of 0 has no period."""
    return d - edge * np.floor(np.divide(d, edge, out=np.zeros_like(d), where=edge > 0) + 0.5)


def _sweeps(x: np.ndarray, old: np.ndarray, im: np.ndarray, i: np.ndarray, j: np.ndarray, d2: np.ndarray, edge: np.ndarray, tol: float, most: int) -> np.ndarray:
    """SHAKE on all groups of a shape at once, x (groups, parts, 3) in place: a sweep goes through the constraints (groups,
    constraints) one by one. Returns the sweeps of each group."""
    g = np.arange(len(x))
    count, live = np.zeros(len(x), np.int32), np.ones(len(x), bool)
    while live.any():
        worst = np.zeros(len(x))
        for c in range(i.shape[1]):
            a, b = i[:, c], j[:, c]
            d = _near(x[g, a] - x[g, b], edge)
            off = np.where(live, (d * d).sum(axis=1) - d2[:, c], 0.0)
            worst = np.maximum(worst, np.abs(off))
            o = _near(old[g, a] - old[g, b], edge)
            s = np.where(np.abs(off) > tol, off / (2.0 * (d * o).sum(axis=1) * (im[g, a] + im[g, b])), 0.0)
            x[g, a] -= (s * im[g, a])[:, None] * o
            x[g, b] += (s * im[g, b])[:, None] * o
        count += live
        live &= (worst > tol) & (count < most)
    return count


def _solves(x: np.ndarray, old: np.ndarray, im: np.ndarray, i: np.ndarray, j: np.ndarray, d2: np.ndarray, edge: np.ndarray, tol: float, most: int) -> np.ndarray:
    """The same by all constraints at once: the couplings between constraints are those of the positions before the step,
    inverted once, and precondition each correction, so constraints that share particles don't undo each other's."""
    n, c = i.shape
    g = np.arange(n)[:, None]
    o = _near(old[g, i] - old[g, j], edge)
    sign = np.zeros((n, c, x.shape[1]))
    sign[g, np.arange(c), i] += 1.0
    sign[g, np.arange(c), j] -= 1.0
    coupling = np.einsum("gcp,gp,gep->gce", sign, im, sign) * np.einsum("gcx,gex->gce", o, o)
    inverse = np.linalg.pinv(2.0 * coupling)
    count, live = np.zeros(n, np.int32), np.ones(n, bool)
    while live.any():
        d = _near(x[g, i] - x[g, j], edge)
        off = (d * d).sum(axis=2) - d2
        live &= (np.abs(off).max(axis=1) > tol) & (count < most)
        push = np.einsum("gce,ge->gc", inverse, np.where(live[:, None], off, 0.0))
        x -= im[:, :, None] * np.einsum("gcp,gc,gcx->gpx", sign, push, o)
        count += live
    return count


def shake(state: DataFrame, constraints: DataFrame, box: Box, dt: float, tol: float = 1e-8, most: int = 100, preconditioned: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Constrained positions and velocities.

    state: (rid, id, m, x, y, z, vx, vy, vz, ox, oy, oz), o the positions before the step; constraints: (rid, i, j, d2).
    Each group is solved until every squared distance is within tol, by sweeps over its constraints or, preconditioned,
    by all of them at once. Groups of equal shape are stacked and solved together. Returns (rid, id, x..vz, sweeps,
    residual) and the columns also of state; a residual over tol says that most was not enough.
    """
    rules = constraints.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("i", "j", "d2"))).alias("c"))
    parts = state.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("id", *STATE, *also))).alias("p"))
    edge = np.array([d if p else 0.0 for d, p in zip(box.dim, box.periodic, strict=True)])
    solver = _solves if preconditioned else _sweeps

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, p, c = b.column(0).to_numpy(), b.column(1), b.column(2)
            n_p, n_c = (np.diff(x.offsets.to_numpy()) for x in (p, c))
            p0, c0 = (x.offsets.to_numpy()[:-1] - x.offsets.to_numpy()[0] for x in (p, c))
            pf, cf = p.flatten(), c.flatten()
            col = {k: pf.field(k).to_numpy() for k in ("id", *STATE)}
            ends = {k: cf.field(k).to_numpy() for k in ("i", "j", "d2")}
            for shape in sorted(set(zip(n_p.tolist(), n_c.tolist(), strict=True))):
                at = np.flatnonzero((n_p == shape[0]) & (n_c == shape[1]))
                own = p0[at][:, None] + np.arange(shape[0])
                rule = c0[at][:, None] + np.arange(shape[1])
                ids = col["id"][own]
                i, j = ((ids[:, None, :] == ends[k][rule][:, :, None]).argmax(axis=2) for k in "ij")
                stack = lambda names, own=own: np.stack([col[k][own] for k in names], axis=2)
                x, old, im, d2 = stack("xyz"), stack(("ox", "oy", "oz")), 1.0 / col["m"][own], ends["d2"][rule]
                start = x.copy()
                count = solver(x, old, im, i, j, d2, edge, tol, most)
                v = stack(("vx", "vy", "vz")) + (x - start) / dt
                g = np.arange(len(at))[:, None]
                left = np.abs((_near(x[g, i] - x[g, j], edge) ** 2).sum(axis=2) - d2).max(axis=1)
                repeat = lambda a, k=shape[0]: np.repeat(a, k)
                flat = [repeat(rid[at]), ids.ravel(), *[x[:, :, k].ravel() for k in range(3)], *[v[:, :, k].ravel() for k in range(3)], repeat(count), repeat(left)]
                rest = [pf.field(k).take(pa.array(own.ravel())) for k in also]
                yield pa.RecordBatch.from_arrays([*[pa.array(a) for a in flat], *rest], names=["rid", "id", "x", "y", "z", "vx", "vy", "vz", "sweeps", "residual", *also])

    kinds = "".join(f", `{c}` {state.schema[c].dataType.simpleString()}" for c in also)
    return parts.join(rules, "rid").mapInArrow(solve, "rid long, id long, x double, y double, z double, vx double, vy double, vz double, sweeps int, residual double" + kinds)
