"""Time steps, thermostat, velocity cap, dissipative particle dynamics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.binning import wrapped
from lattica.operators.constraints import shake
from lattica.operators.observables import V, com_velocity, square
from lattica.operators.pairs import neighbour_pairs
from lattica.schema import Box

FORCES = ("fx", "fy", "fz")


def moved(rows: DataFrame, forces: DataFrame, dt: float) -> DataFrame:
    """Leapfrog: v += dt f / m, then x += dt v. rows have m; a particle without a force keeps its velocity."""
    met = rows.join(forces.select("id", *FORCES), "id", "left")
    out = met.withColumns({v: F.col(v) + F.lit(dt) * F.coalesce(F.col(f), F.lit(0.0)) / F.col("m") for v, f in zip(V, FORCES, strict=True)})
    return out.withColumns({x: F.col(x) + F.lit(dt) * F.col(v) for x, v in zip("xyz", V, strict=True)}).drop(*FORCES)


def advanced(rows: DataFrame, forces: DataFrame, dt: float, box: Box) -> DataFrame:
    """moved() and wrapped."""
    return wrapped(moved(rows, forces, dt), box)


def members(constraints: DataFrame) -> DataFrame:
    """(rid, id): the particles of rigid groups."""
    return constraints.select("rid", F.explode(F.array("i", "j")).alias("id")).distinct()


def solved(rows: DataFrame, constraints: DataFrame, box: Box, dt: float, preconditioned: bool = False) -> DataFrame:
    """rows with the particles of rigid groups put back on their constraints (rid, i, j, d2). rows have rid, null where a
    particle is in no group, and ox, oy, oz, its place before the step; both are left out of what is returned. Particles go
    through the solve as a whole, so that rows are not joined with what it found."""
    cols = [c for c in rows.columns if c not in ("rid", "ox", "oy", "oz")]
    also = tuple(c for c in cols if c not in ("id", "m", "x", "y", "z", *V))
    held = rows.where(F.col("rid").isNotNull()).withColumn("_m", F.col("m"))
    found = shake(held, constraints, box, dt, preconditioned=preconditioned, also=(*also, "_m"))
    return found.withColumnRenamed("_m", "m").select(*cols).union(rows.where(F.col("rid").isNull()).select(*cols))


def constrained(rows: DataFrame, before: DataFrame, constraints: DataFrame, box: Box, dt: float, preconditioned: bool = False) -> DataFrame:
    """rows with the particles of rigid groups put back on their constraints (rid, i, j, d2); before are the same particles
    before the step."""
    old = before.select("id", *[F.col(c).alias(f"o{c}") for c in "xyz"])
    return solved(rows.join(members(constraints), "id", "left").join(old, "id"), constraints, box, dt, preconditioned).select(*rows.columns)


def thermostat(rows: DataFrame, temperature: DataFrame, target: float, strength: float) -> DataFrame:
    """Velocities scaled by sqrt(1 + strength (target / T - 1)). temperature is one row."""
    scale = temperature.select(F.sqrt(1.0 + F.lit(strength) * (F.lit(target) / F.col("temperature") - 1.0)).alias("w"))
    return rows.crossJoin(F.broadcast(scale)).withColumns({v: F.col(v) * F.col("w") for v in V}).drop("w")


def capped(rows: DataFrame, most: float) -> DataFrame:
    """Velocities above most scaled down to it."""
    speed = F.sqrt(square(*V))
    met = rows.withColumn("_s", F.when(speed > most, F.lit(most) / speed).otherwise(1.0))
    return met.withColumns({v: F.col(v) * F.col("_s") for v in V}).drop("_s")


def projected(rows: DataFrame, forces: DataFrame, dt: float) -> DataFrame:
    """Velocities half a step on: v + dt f / (2 m)."""
    met = rows.join(forces, "id", "left")
    return met.withColumns({v: F.col(v) + F.lit(0.5 * dt) * F.coalesce(F.col(f), F.lit(0.0)) / F.col("m") for v, f in zip(V, FORCES, strict=True)}).drop(*FORCES)


#: Moduli and factors of the noise: primes below 2^31, so that no product leaves 64 bits. Fixed values.
PRIME, OTHER = 2147483647, 2147483629
FACTORS = (1103515245, 12345678, 69621, 48271, 16807, 1664525)


def uniform(i: Column, j: Column, seed: int, step: int = 0) -> Column:
    """In (0, 1), the same for (i, j) and (j, i) and another for each step, from integer arithmetic that any engine has."""
    lo, hi = F.least(i, j) % PRIME, F.greatest(i, j) % PRIME
    a = (lo * FACTORS[0] + hi * FACTORS[1] + F.lit((seed * 1000003 + step) % PRIME * FACTORS[2])) % PRIME
    b = (a * a) % OTHER
    c = (b * FACTORS[3] + hi * FACTORS[4] + lo) % PRIME
    d = (c * c % OTHER * FACTORS[5] + b) % PRIME
    return (d + 0.5) / float(PRIME)


# Coefficients of a rational approximation of the inverse normal distribution (relative error below 1.2e-9), for the
# middle and for the tails below NORMAL_LOW: fixed values.
NORMAL_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
NORMAL_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
NORMAL_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
NORMAL_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
NORMAL_LOW = 0.02425


def polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for c in factors[1:]:
        out = out * x + F.lit(c)
    return out


def with_normal(rows: DataFrame, u: Column, name: str) -> DataFrame:
    """rows with a column of the inverse of the normal distribution at u. What its formula repeats are columns first, so
    that each is worked out once and the generated code stays small enough to be compiled."""
    least = F.least(F.col("_u"), 1.0 - F.col("_u"))
    steps = rows.withColumn("_u", u).withColumns({"_t": F.sqrt(-2.0 * F.ln(least)), "_q": F.col("_u") - 0.5}).withColumn("_q2", F.col("_q") * F.col("_q"))
    tail = polynomial(F.col("_t"), NORMAL_C) / polynomial(F.col("_t"), NORMAL_D)
    middle = F.col("_q") * polynomial(F.col("_q2"), NORMAL_A) / polynomial(F.col("_q2"), NORMAL_B)
    out = F.when(F.abs("_q") <= 0.5 - NORMAL_LOW, middle).otherwise(-F.signum("_q") * tail)
    return steps.withColumn(name, out).drop("_u", "_t", "_q", "_q2")


def random_velocities(ps: DataFrame, speed: float, seed: int) -> DataFrame:
    """Velocities of one speed in directions drawn by id, evenly over the sphere, less the velocity of the centre of mass.
    Rows have m."""
    id_ = F.col("id").cast("long")
    up, turn = 2.0 * uniform(id_, id_, seed, 1) - 1.0, 2.0 * math.pi * uniform(id_, id_, seed, 2)
    flat = F.sqrt(1.0 - up * up)
    drawn = ps.withColumns({"vx": speed * flat * F.cos(turn), "vy": speed * flat * F.sin(turn), "vz": speed * up})
    return without_drift(drawn)


def without_drift(rows: DataFrame) -> DataFrame:
    """Velocities less that of the centre of mass, which is one row."""
    drift = com_velocity(rows).select(*[F.col(f"com_{v}").alias(f"_{v}") for v in V])
    return rows.crossJoin(F.broadcast(drift)).withColumns({v: F.col(v) - F.col(f"_{v}") for v in V}).drop(*[f"_{v}" for v in V])


def dpd_pairs(ps: DataFrame, box: Box, alpha: float, gamma: float, dt: float, seed: int, step: int = 0) -> DataFrame:
    """Pairs with f, a repulsive magnitude over r: soft repulsion, drag and noise keyed by (seed, step, i, j). The drag
    takes the velocities that ps has; in a run they are those of projected().

    w = 1 - r / cutoff; f = ((-gamma w (d . dv) / r + sqrt(2 / dt) Z) gamma + alpha) w / r. To be spread with +f d on i.
    """
    pairs = neighbour_pairs(ps, box, ("id", "x", "y", "z", *V))
    r = F.sqrt("r2")
    rows = with_normal(pairs, uniform(F.col("i"), F.col("j"), seed, step), "z").withColumns({"r": r, "w": 1.0 - r / F.lit(box.cutoff)})
    along = sum((F.col(d) * (F.col(f"{v}_i") - F.col(f"{v}_j")) for d, v in zip(("dx", "dy", "dz"), V, strict=True)), F.lit(0.0)) / F.col("r")
    f = ((-F.lit(gamma) * F.col("w") * along + F.lit(math.sqrt(2.0 / dt)) * F.col("z")) * F.lit(gamma) + F.lit(alpha)) * F.col("w") / F.col("r")
    return rows.withColumn("f", -f)
