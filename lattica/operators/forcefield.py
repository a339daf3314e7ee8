"""Assignment of parameters to topology by species names, combining rule, inner radius, split of rigid hydrogens."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combined(types: DataFrame) -> DataFrame:
    """(type_i, type_j, a, b, qq) of every ordered pair of species (a table of species, not of particles): epsilon is
    the geometric mean and r0 the sum of the radii; a = eps r0^12, b = 2 eps r0^6."""
    side = lambda s: types.select(*[F.col(c).alias(f"{c}_{s}") for c in ("type", "eps", "rmin", "charge")])
    met = side("i").join(side("j"), F.lit(True))
    eps, r0 = F.sqrt(F.col("eps_i") * F.col("eps_j")), F.col("rmin_i") + F.col("rmin_j")
    r6 = r0 * r0 * r0 * r0 * r0 * r0
    return met.select("type_i", "type_j", (eps * r6 * r6).alias("a"), (2.0 * eps * r6).alias("b"), (F.col("charge_i") * F.col("charge_j")).alias("qq"))


def inner_radius(energy: Callable[[float], float], r0: float, tol: float = 1e-5) -> float:
    """Where a table may start: the smallest r in [r0 / 2, r0] at which |V| is still under twice |V(r0)|."""
    lo, hi, top = 0.5 * r0, r0, 2.0 * abs(energy(r0))
    if abs(energy(lo)) < top:
        return lo
    while hi - lo > tol:
        mid = 0.5 * (lo + hi)
        lo, hi = (lo, mid) if abs(energy(mid)) < top else (mid, hi)
    return hi


def electrostatics(kappa: float) -> str:
    """Mode by the screening parameter: none below zero, shifted at zero, ewald above; potentials.nonbonded() is its term."""
    return "none" if kappa < 0 else "shifted" if kappa == 0 else "ewald"


def type_of(types: DataFrame, by: str = "name") -> DataFrame:
    """(name, type): the first species of each name, by name or by name2, as a lookup finds it."""
    return types.groupBy(F.col(by).alias("name")).agg(F.min("type").alias("type"))


def without_vertex(angles: DataFrame, named: DataFrame, species: str) -> DataFrame:
    """Angles whose vertex j is not of a species, such as those of rigid water. named: (id, name)."""
    return angles.join(named.where(F.col("name") == species).select(F.col("id").alias("j")), "j", "left_anti").select(*angles.columns)


def water_numbered(ps: DataFrame, named: DataFrame, oxygen: str = "OT") -> DataFrame:
    """ps with vid := the oxygen's id for every oxygen and the two hydrogens after it, by an equi-join on ids."""
    parts = named.where(F.col("name") == oxygen).select(F.col("id").alias("_o"), F.explode(F.sequence(F.col("id"), F.col("id") + 2)).alias("id"))
    return ps.join(parts, "id", "left").withColumn("vid", F.coalesce("_o", "vid")).select(*ps.columns)


def _names(topology: DataFrame, named: DataFrame, ends: str) -> DataFrame:
    """topology with the species name of each end; named: (id, name)."""
    out = topology
    for e in ends:
        out = out.join(named.select(F.col("id").alias(e), F.col("name").alias(f"n_{e}")), e)
    return out


def _assigned(topology: DataFrame, named: DataFrame, params: DataFrame, ends: str, key: str, last: bool, wild: bool) -> DataFrame:
    """topology, left-joined with the parameters (columns t1.., line, and more) that fit its names in either direction.

    Matches are found per combination of names, of which there are few, and joined back by names; last says whether
    the last or the first line of the file wins; wild allows X for any name.
    """
    rows = _names(topology, named, ends)
    cols = [f"n_{e}" for e in ends]
    kinds = rows.select(*cols).distinct()
    ts = [f"t{n + 1}" for n in range(len(ends))]

    def fits(order: list[str]) -> Column:
        ok = F.lit(True)
        for t, n in zip(order, cols, strict=True):
            ok &= (F.col(t) == F.col(n)) | (F.col(t) == "X") if wild else F.col(t) == F.col(n)
        return ok

    values = [c for c in params.columns if c not in ts]
    met = kinds.join(params, fits(ts) | fits(ts[::-1]))
    best = (F.max_by if last else F.min_by)(F.struct(*values), "line")
    chosen = met.groupBy(*cols).agg(best.alias("_p")).select(*cols, *[F.col(f"_p.{c}").alias(c) for c in values])
    return rows.join(chosen, cols, "left").select(key, *ends, *cols, *values)


def assigned_bonds(bonds: DataFrame, named: DataFrame, params: DataFrame) -> DataFrame:
    """Unordered pair of names; the last line wins."""
    return _assigned(bonds, named, params, "ij", "bid", True, False)


def assigned_angles(angles: DataFrame, named: DataFrame, params: DataFrame) -> DataFrame:
    """Triple of names in either direction; the last line wins."""
    return _assigned(angles, named, params, "ijk", "aid", True, False)


def assigned_dihedrals(dihedrals: DataFrame, named: DataFrame, params: DataFrame) -> DataFrame:
    """Four names in either direction, X for any; the first line wins."""
    return _assigned(dihedrals, named, params, "ijkl", "did", False, True)


def split_hydrogens(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(constraints, bonds): bonds with an end whose name starts with H become constraints (i, j, d)."""
    h = F.upper(F.substring("n_i", 1, 1)).eqNullSafe("H") | F.upper(F.substring("n_j", 1, 1)).eqNullSafe("H")
    return assigned.where(h & F.col("r0").isNotNull()).select("bid", "i", "j", F.col("r0").alias("d")), assigned.where(~h)


def missing(assigned: DataFrame, value: str) -> DataFrame:
    """Interactions that no parameter line fits."""
    return assigned.where(F.col(value).isNull())


def lj_minimum(a: float, b: float) -> float:
    """Radius of the lowest energy of a / r^12 - b / r^6."""
    return math.pow(2.0 * a / b, 1.0 / 6.0)
