"""A deterministic rigid-water system derived from the orders table; see FIXTURES.md."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.integrate import random_velocities
from lattica.schema import Box

SPACING, CUTOFF = 0.3125, 0.75


def lattice_edge(atoms: int) -> int:
    """Molecules along an edge of the smallest cube that holds all."""
    nx = 1
    while nx**3 * 3 < atoms:
        nx += 1
    return nx


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")


@lru_cache(maxsize=16)
def _edge(spark: SparkSession, sf_dir: str) -> int:
    return lattice_edge(orders(spark, sf_dir).count())


def box(spark: SparkSession, sf_dir: str, cutoff: float = CUTOFF) -> Box:
    edge = _edge(spark, sf_dir) * SPACING
    return Box((0.0, 0.0, 0.0), (edge,) * 3, cutoff)


def wrapped(u: Column, edge: float) -> Column:
    return u - F.lit(edge) * F.floor(u / F.lit(edge))


def particles(spark: SparkSession, sf_dir: str, displaced: bool = False, wrap: bool = True) -> DataFrame:
    """The particle table. displaced adds small exact shifts, so that molecules differ."""
    keys = orders(spark, sf_dir)
    nx = _edge(spark, sf_dir)  # counted once per session and table
    edge = nx * SPACING
    i = F.col("o_orderkey").cast("long")
    mol = F.floor(i / 3)
    a = (i % 3).cast("int")
    base = keys.select(i.alias("id"), mol.alias("mol"), a.alias("a"))
    cells = (F.floor(F.col("mol") / (nx * nx)), F.floor(F.col("mol") / nx) % nx, F.col("mol") % nx)
    offsets = ((0.0, 0.1015625, -0.03125), (0.0, 0.0, 0.09375), (0.0, 0.0, 0.0))
    at = []
    for cell, prime, off, k in zip(cells, (7919, 104729, 1299709), offsets, (13, 29, 43), strict=True):
        u = cell * SPACING + (F.col("mol") * prime) % 8 / 256.0 + F.element_at(F.array(*[F.lit(o) for o in off]), F.col("a") + 1)
        if displaced:
            u = u + (F.col("id") * k) % 8 / 512.0
        at.append(wrapped(u, edge) if wrap else u)
    kind = F.when(F.col("a") == 0, 0).otherwise(1)
    speed = [((F.col("id") * p) % 257 - 128) / 256.0 for p in (31, 37, 41)]
    return base.select(
        "id", F.col("mol").alias("vid"), kind.alias("type"), F.lit(0).alias("flags"), F.when(kind == 0, -0.8476).otherwise(0.4238).alias("q"),
        *[u.alias(c) for u, c in zip(at, "xyz", strict=True)], *[v.alias(c) for v, c in zip(speed, ("vx", "vy", "vz"), strict=True)],
    )


def lattice(spark: SparkSession, n: int, box: Box, mass: float, speed: float, seed: int) -> DataFrame:
    """n particles of one species in the middle of the cells of the smallest cubic lattice that holds them, with random
    velocities of one speed less their drift."""
    nx = 1
    while nx**3 < n:
        nx += 1
    i = F.col("id")
    at = (F.floor(i / (nx * nx)), F.floor(i / nx) % nx, i % nx)
    places = {c: (k + 0.5) * (d / nx) + o for c, k, d, o in zip("xyz", at, box.dim, box.origin, strict=True)}
    ps = spark.range(n).withColumns({"vid": i, "type": F.lit(0), "flags": F.lit(0), "q": F.lit(0.0), **places, "m": F.lit(mass)})
    return random_velocities(ps, speed, seed)


def types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "OT", "OT-0.8476", 15.9994, -0.8476, 0.6364, 0.1776), (1, "HT", "HT0.4238", 1.00794, 0.4238, 0.1924, 0.0225)], "type int, name string, name2 string, mass double, charge double, eps double, rmin double")


def bonds(ps: DataFrame) -> DataFrame:
    """(3k, 3k+1) and (3k, 3k+2)."""
    o = ps.where("id % 3 = 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("s"))
    return o.select((F.floor(F.col("id") / 3) * 2 + F.col("s") - 1).alias("bid"), F.col("id").alias("i"), (F.col("id") + F.col("s")).alias("j"))


def angles(ps: DataFrame) -> DataFrame:
    return ps.where("id % 3 = 0").select(F.col("vid").alias("aid"), (F.col("id") + 1).alias("i"), F.col("id").alias("j"), (F.col("id") + 2).alias("k"), F.lit(0).alias("pid"))


def dihedrals(ps: DataFrame, atoms: int) -> DataFrame:
    """H1 - O - O' - H2' of molecules that follow each other in a lattice row."""
    nx = lattice_edge(atoms)
    o = ps.where((F.col("id") % 3 == 0) & (F.col("vid") % nx < nx - 1) & (F.col("id") + 5 < atoms))
    return o.select(F.col("vid").alias("did"), (F.col("id") + 1).alias("i"), F.col("id").alias("j"), (F.col("id") + 3).alias("k"), (F.col("id") + 5).alias("l"), F.lit(0).alias("pid"), F.lit(False).alias("improper"))


def cte(displaced: bool = False, wrap: bool = True) -> str:
    """DuckDB: CTEs n, g(nx, edge) and p (the particle table with mass m), to follow WITH."""

    def axis(cell: str, prime: int, off: tuple[float, ...], k: int) -> str:
        d = f" + ((id * {k}) % 8) / 512e0" if displaced else ""
        u = f"({cell}) * 3125e-4 + ((mol * {prime}) % 8) / 256e0 + CASE a WHEN 0 THEN {off[0]!r}::DOUBLE WHEN 1 THEN {off[1]!r}::DOUBLE ELSE {off[2]!r}::DOUBLE END{d}"
        return f"({u}) - edge * floor(({u}) / edge)" if wrap else u

    return f"""
n AS (SELECT count(*) AS atoms FROM orders),
g AS (SELECT min(r) AS nx, min(r) * 3125e-4 AS edge FROM n, range(1, 2000) AS t(r) WHERE r * r * r * 3 >= atoms),
b AS (SELECT o_orderkey AS id, o_orderkey // 3 AS mol, (o_orderkey % 3)::INT AS a, nx, edge FROM orders, g),
p AS (SELECT id, mol AS vid, CASE a WHEN 0 THEN 0 ELSE 1 END AS type, CASE a WHEN 0 THEN -8476e-4 ELSE 4238e-4 END AS q,
    CASE a WHEN 0 THEN 159994e-4 ELSE 100794e-5 END AS m,
    {axis("mol // (nx * nx)", 7919, (0.0, 0.1015625, -0.03125), 13)} AS x,
    {axis("(mol // nx) % nx", 104729, (0.0, 0.0, 0.09375), 29)} AS y,
    {axis("mol % nx", 1299709, (0.0, 0.0, 0.0), 43)} AS z,
    ((id * 31) % 257 - 128) / 256e0 AS vx, ((id * 37) % 257 - 128) / 256e0 AS vy, ((id * 41) % 257 - 128) / 256e0 AS vz, nx, edge FROM b)"""
