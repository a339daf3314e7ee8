"""Bonds, angles, dihedrals: equi-joins of a topology table with the particles, geometry as column expressions.

An interaction is left out if one of its particles is missing or all are ghosts. Forces are minus the gradient.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.potentials import Term, angle_energy, dihedral_energy, dihedral_energy_of, harmonic
from lattica.operators.binning import image
from lattica.operators.state import small
from lattica.schema import GHOST, Box

Vec = tuple[Column, Column, Column]
FORCES = ("fx", "fy", "fz")


def placed(topology: DataFrame, ps: DataFrame, ends: str) -> DataFrame:
    """topology with type, x, y, z, flags of each end, suffixed by its letter."""
    out = topology
    for e in ends:
        side = ps.select(F.col("id").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("type", "x", "y", "z", "flags")])
        out = out.join(side, e)
    ghosts = [F.col(f"flags_{e}").bitwiseAND(F.lit(GHOST)) > 0 for e in ends]
    return out.where(~reduce(lambda a, b: a & b, ghosts))


def between(a: str, b: str, box: Box) -> Vec:
    """Minimum image of a - b."""
    return tuple(image(F.col(f"{c}_{a}") - F.col(f"{c}_{b}"), d) if p else F.col(f"{c}_{a}") - F.col(f"{c}_{b}") for c, d, p in zip("xyz", box.dim, box.periodic, strict=True))  # type: ignore[return-value]


def named(df: DataFrame, **vectors: Vec) -> DataFrame:
    """Adds each vector as columns, so that later expressions read it rather than repeat it."""
    return df.withColumns({f"{n}{c}": u for n, v in vectors.items() for c, u in zip("xyz", v, strict=True)})


def vec(n: str) -> Vec:
    return F.col(f"{n}x"), F.col(f"{n}y"), F.col(f"{n}z")


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def times(s: Column, a: Vec) -> Vec:
    return s * a[0], s * a[1], s * a[2]


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def ends(df: DataFrame, parts: dict[str, Vec]) -> DataFrame:
    """(id, fx, fy, fz, e): a row per end of each interaction with its force; the first end has the energy, others 0."""
    first = next(iter(parts))
    rows = F.array(*[F.struct(F.col(x).cast("long").alias("id"), *[u.alias(n) for u, n in zip(v, FORCES, strict=True)], (F.col("e") if x == first else F.lit(0.0)).alias("e")) for x, v in parts.items()])
    return df.select(F.explode(rows).alias("w")).select("w.*")


def spread(df: DataFrame, parts: dict[str, Vec]) -> DataFrame:
    """(id, fx, fy, fz): forces on the ends, summed."""
    return ends(df, parts).groupBy("id").agg(*[F.sum(c).alias(c) for c in FORCES])


def bond_terms(bonds: DataFrame, ps: DataFrame, bond_pot: DataFrame, box: Box) -> DataFrame:
    """bonds with dx, dy, dz, r2, e, f. bond_pot: (type_i, type_j, k, r0, a, b) in both orders; lengths are held to
    [a, b] for the energy, and bonds whose types have no potential are left out."""
    rows = named(placed(bonds, ps, "ij"), d=between("i", "j", box)).join(small(bond_pot), ["type_i", "type_j"])
    rows = rows.withColumn("r2", dot(vec("d"), vec("d")))
    r = F.sqrt(F.least(F.greatest(F.col("r2"), F.col("a") * F.col("a")), F.col("b") * F.col("b")))
    rows = rows.withColumn("r", r)
    t = harmonic(F.col("r"), F.col("k"), F.col("r0"))
    return rows.withColumns({"e": t.e, "f": t.f})


def bond_parts(terms: DataFrame) -> tuple[DataFrame, dict[str, Vec]]:
    return terms, {"i": times(-F.col("f"), vec("d")), "j": times(F.col("f"), vec("d"))}


def bond_forces(terms: DataFrame) -> DataFrame:
    return spread(*bond_parts(terms))


def angle_terms(angles: DataFrame, ps: DataFrame, box: Box, k: Column | float, theta0: Column | float, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """angles (vertex j) with arms u, v, their lengths, c = cos, e and de = dE/dc; c is held to [lo, hi]. k and theta0 are
    numbers, or columns of angles, as a parameter file's assignment gives them."""
    rows = named(placed(angles, ps, "ijk"), u=between("i", "j", box), v=between("k", "j", box))
    rows = rows.withColumns({"nu": F.sqrt(dot(vec("u"), vec("u"))), "nv": F.sqrt(dot(vec("v"), vec("v")))})
    rows = rows.withColumn("raw", dot(vec("u"), vec("v")) / (F.col("nu") * F.col("nv")))
    rows = rows.withColumn("c", F.least(F.greatest(F.col("raw"), F.lit(lo)), F.lit(hi)))
    e, de = angle_energy(F.col("c"), k, theta0)
    return rows.withColumns({"e": e, "de": de})


def angle_parts(terms: DataFrame) -> tuple[DataFrame, dict[str, Vec]]:
    c, de, nu, nv = F.col("raw"), F.col("de"), F.col("nu"), F.col("nv")
    gi = times(1.0 / nu, minus(times(1.0 / nv, vec("v")), times(c / nu, vec("u"))))
    gk = times(1.0 / nv, minus(times(1.0 / nu, vec("u")), times(c / nv, vec("v"))))
    rows = named(terms, i_=times(-de, gi), k_=times(-de, gk))
    both = tuple(-(p + q) for p, q in zip(vec("i_"), vec("k_"), strict=True))
    return rows, {"i": vec("i_"), "j": both, "k": vec("k_")}


def angle_forces(terms: DataFrame) -> DataFrame:
    return spread(*angle_parts(terms))


def dihedral_terms(dihedrals: DataFrame, ps: DataFrame, box: Box, k: Column | float, n: Column | int, delta: Column | float) -> DataFrame:
    """dihedrals with a = xi - xj, b = xk - xj, c = xl - xk, normals m = a x b and n = c x b, cosphi, e and de. k, n and
    delta are numbers, or all columns of dihedrals."""
    rows = named(placed(dihedrals, ps, "ijkl"), a=between("i", "j", box), b=between("k", "j", box), c=between("l", "k", box))
    rows = named(rows, m=cross(vec("a"), vec("b")), n=cross(vec("c"), vec("b")))
    rows = rows.withColumns({"m2": dot(vec("m"), vec("m")), "n2": dot(vec("n"), vec("n"))})
    cos = dot(vec("m"), vec("n")) / F.sqrt(F.col("m2") * F.col("n2"))
    rows = rows.withColumn("cosphi", F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))
    energy = dihedral_energy_of if isinstance(n, Column) else dihedral_energy
    e, de = energy(F.col("cosphi"), k, n, delta)  # type: ignore[arg-type]
    return rows.withColumns({"e": e, "de": de})


def dihedral_parts(terms: DataFrame) -> tuple[DataFrame, dict[str, Vec]]:
    """By the chain rule through the normals: with p = dcos/dm and q = dcos/dn, the ends get b x p and b x q, and b's
    share a x p + c x q, with its sign, goes to the middle."""
    s = F.sqrt(F.col("m2") * F.col("n2"))
    p = minus(times(1.0 / s, vec("n")), times(F.col("cosphi") / F.col("m2"), vec("m")))
    q = minus(times(1.0 / s, vec("m")), times(F.col("cosphi") / F.col("n2"), vec("n")))
    rows = named(terms, p=p, q=q)
    rows = named(rows, ga=cross(vec("b"), vec("p")), gc=cross(vec("b"), vec("q")))
    ap, cq = cross(vec("p"), vec("a")), cross(vec("q"), vec("c"))
    rows = named(rows, gb=tuple(x + y for x, y in zip(ap, cq, strict=True)))
    de = -F.col("de")
    ga, gb, gc = vec("ga"), vec("gb"), vec("gc")
    on_j = tuple(-(x + y) for x, y in zip(ga, gb, strict=True))
    on_k = tuple(x - y for x, y in zip(gb, gc, strict=True))
    return rows, {"i": times(de, ga), "j": times(de, on_j), "k": times(de, on_k), "l": times(de, gc)}


def dihedral_forces(terms: DataFrame) -> DataFrame:
    return spread(*dihedral_parts(terms))


def excluded_terms(exclusions: DataFrame, ps: DataFrame, pair_pot: DataFrame, box: Box, term) -> DataFrame:  # noqa: ANN001
    """Excluded pairs within the cutoff that have a potential, with e negated: what to add to the pair energy."""
    rows = named(placed(exclusions, ps, "ij"), d=between("i", "j", box)).join(small(pair_pot), ["type_i", "type_j"])
    rows = rows.withColumn("r2", dot(vec("d"), vec("d"))).where(F.col("r2") <= box.cutoff**2)
    t: Term = term(rows)
    return rows.withColumns({"e": -t.e, "f": -t.f})
