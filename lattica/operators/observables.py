"""Energies, temperatures, momenta and other sums over particles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.binning import AXES, differences, half_shell, image
from lattica.operators.state import running, small
from lattica.schema import GAS, Box

V = ("vx", "vy", "vz")


def massed(ps: DataFrame, types: DataFrame) -> DataFrame:
    """Adds m. types has a row per species."""
    return ps.join(small(types.select("type", F.col("mass").alias("m"))), "type")


def square(*cols: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in cols])


def kinetic(rows: DataFrame) -> DataFrame:
    """(n, ekin) of rows with m and velocities."""
    return rows.agg(F.count("*").alias("n"), F.sum(0.5 * F.col("m") * square(*V)).alias("ekin"))


def kinetic_half_step(rows: DataFrame, forces: DataFrame, dt: float) -> DataFrame:
    """Kinetic energy half a step back: v - dt f / (2 m)."""
    met = rows.join(forces, "id", "left")
    back = met.withColumns({v: F.col(v) - F.lit(0.5 * dt) * F.coalesce(F.col(f), F.lit(0.0)) / F.col("m") for v, f in zip(V, ("fx", "fy", "fz"), strict=True)})
    return kinetic(back)


def temperature(rows: DataFrame, constraints: int = 0) -> DataFrame:
    """(ekin, temperature) with 3 n - constraints degrees of freedom."""
    return kinetic(rows).select("ekin", (2.0 * F.col("ekin") / (F.lit(GAS) * (3 * F.col("n") - constraints))).alias("temperature"))


def com_velocity(rows: DataFrame) -> DataFrame:
    """Total mass, momenta and velocity of the centre of mass."""
    sums = rows.agg(F.sum("m").alias("mass"), *[F.sum(F.col("m") * F.col(v)).alias(f"p{v[1]}") for v in V])
    return sums.select("*", *[(F.col(f"p{v[1]}") / F.col("mass")).alias(f"com_{v}") for v in V])


def molecular_temperature(rows: DataFrame) -> DataFrame:
    """Temperature of the molecules' centres of mass: sums per vid, then over all."""
    mols = rows.groupBy("vid").agg(F.sum("m").alias("m"), *[(F.sum(F.col("m") * F.col(v)) / F.sum("m")).alias(v) for v in V])
    return kinetic(mols).select(F.col("n").alias("molecules"), "ekin", (2.0 * F.col("ekin") / (3.0 * F.lit(GAS) * F.col("n"))).alias("temperature"))


def max_displacement(now: DataFrame, then: DataFrame, box: Box) -> DataFrame:
    """(maxdx): largest way, by minimum image, between two states."""
    met = now.alias("a").join(then.alias("b"), F.col("a.id") == F.col("b.id"))
    dx, dy, dz = differences("a", "b", box)
    return met.select(dx.alias("dx"), dy.alias("dy"), dz.alias("dz")).agg(F.max(F.sqrt(square("dx", "dy", "dz"))).alias("maxdx"))


def displacement(rows: DataFrame, then: tuple[str, ...], box: Box) -> DataFrame:
    """The same for rows that carry where they were, in the columns then."""
    way = [F.col(c) - F.col(t) for c, t in zip(AXES, then, strict=True)]
    near = [image(d, e) if p else d for d, e, p in zip(way, box.dim, box.periodic, strict=True)]
    return rows.select(*[d.alias(f"d{c}") for d, c in zip(near, AXES, strict=True)]).agg(F.max(F.sqrt(square("dx", "dy", "dz"))).alias("maxdx"))


def rebuild_needed(displacement: DataFrame, skin: float, cutoff: float) -> DataFrame:
    """Whether the pair list has to be made anew: 2 maxdx > skin or maxdx > cutoff / 4."""
    return displacement.select("maxdx", ((2.0 * F.col("maxdx") > skin) | (F.col("maxdx") > 0.25 * cutoff)).alias("rebuild"))


def cell_counts(binned_ps: DataFrame) -> DataFrame:
    return binned_ps.groupBy("cell").agg(F.count("*").alias("n"))


def cell_offsets(binned_ps: DataFrame) -> DataFrame:
    """(cell, n, start): particles in the cells before."""
    return running(cell_counts(binned_ps), "start", "cell", of=F.col("n")).select("cell", "n", F.col("start").cast("long").alias("start"))


def cell_energies(terms: DataFrame, binned_ps: DataFrame) -> DataFrame:
    """(cell, e): the energy of a pair belongs to the cell of its first particle; terms have i and e."""
    return terms.join(binned_ps.select(F.col("id").alias("i"), "cell"), "i").groupBy("cell").agg(F.sum("e").alias("e"))


#: Weights of a neighbour that shares a face, an edge or a corner: fixed values.
SHARE = {1: 0.50004, 2: 0.16176, 3: 0.036213}


def load_weights(binned_ps: DataFrame, box: Box) -> DataFrame:
    """(cell, n, weight): expected work of a cell, n^2 - n and a share of n m for each neighbour; shows skew."""
    counts = binned_ps.groupBy("cx", "cy", "cz", "cell").agg(F.count("*").alias("n"))
    offs = [o for o in half_shell(box) if o != (0, 0, 0)]
    both = F.array(*[F.struct(*[F.lit(s * v).alias(k) for k, v in zip("abc", o, strict=True)], F.lit(SHARE[sum(map(bool, o))]).alias("w")) for o in offs for s in (1, -1)])
    near = counts.select("cell", "n", *[F.col(c).alias(f"o{c}") for c in ("cx", "cy", "cz")], F.explode(both).alias("o"))
    moved = near.select("cell", "n", F.col("o.w").alias("w"), *[F.pmod(F.col(f"o{c}") + F.col(f"o.{k}"), F.lit(m)).alias(c) for c, k, m in zip(("cx", "cy", "cz"), "abc", box.cells, strict=True)])
    met = moved.join(counts.select("cx", "cy", "cz", F.col("n").alias("m")), ["cx", "cy", "cz"])
    shared = met.groupBy("cell").agg(F.sum(F.col("w") * F.col("n") * F.col("m")).alias("s"))
    return counts.join(shared, "cell", "left").select("cell", "n", (F.col("n") * F.col("n") - F.col("n") + F.coalesce("s", F.lit(0.0))).alias("weight"))


def breakdown(**terms: DataFrame) -> DataFrame:
    """(term, value): summed column e of each table, and their total."""
    parts = [df.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("e")).select(F.lit(name).alias("term"), "e") for name, df in terms.items()]
    union = reduce(DataFrame.union, parts)
    return union.rollup("term").agg(F.sum("e").alias("value")).select(F.coalesce("term", F.lit("total")).alias("term"), "value")
