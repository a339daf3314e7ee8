"""Queries over the water system derived from orders, and DuckDB SQL that gets the same by brute force."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import potentials as pot
from lattica.functions import tables
from lattica.operators import binning, bonded, constraints, forcefield, integrate, longrange, observables, pairs
from lattica.operators.state import settled, shared_folder
from lattica.plans import fixtures
from lattica.plans.registry import ForceField, TopologyBuilder
from lattica.plans.system import CLASSES, ParticleSystem
from lattica.schema import COULOMB, GAS, Box
from lattica.sources import arrays, parameters, structure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The oxygens' Lennard-Jones parameters, bond, angle and dihedral: fixed values.
A, B = 2.637775819766153e-06, 2.619222661792581e-03
KAPPA, ON, RC = 3.0, 0.6, fixtures.CUTOFF
BOND_K, BOND_R0, BOND_A, BOND_B = 231850.0, 0.1, 0.05, 0.15
ANGLE_K, THETA0 = 191.5, 1.91061193
DIH_K, DIH_N = 0.2, 3
DT, SKIN = 0.002, 0.1


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + sql.strip() if not sql.lstrip().upper().startswith(("SELECT", "WITH")) else sql
        return f

    return keep


def r4(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4) + 0.0


def water(spark: SparkSession, sf_dir: str, displaced: bool = False) -> tuple[DataFrame, Box]:
    return fixtures.particles(spark, sf_dir, displaced), fixtures.box(spark, sf_dir)


def oo(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, A, B)], "type_i int, type_j int, a double, b double")


def every_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, j, A if i + j == 0 else 0.0, B if i + j == 0 else 0.0) for i in (0, 1) for j in (0, 1)], "type_i int, type_j int, a double, b double")


def oxygen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of oxygens, with their potential; others are left out before the join on cells."""
    ps, box = water(spark, sf_dir)
    return pairs.with_potential(pairs.neighbour_pairs(ps.where("type = 0"), box), oo(spark))


def pair_rows(spark: SparkSession, sf_dir: str, table: DataFrame) -> DataFrame:
    ps, box = water(spark, sf_dir)
    return pairs.with_potential(pairs.neighbour_pairs(ps, box), table)


def summed(rows: DataFrame, term: pot.Term) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), r4(F.sum(term.e)).alias("e"))


QQ = lambda: F.col("q_i") * F.col("q_j")
P, PD = fixtures.cte(), fixtures.cte(True)
N = lambda x: f"{x!r}::DOUBLE"
IMG = lambda d: f"({d}) - edge * floor(({d}) / edge + 0.5::DOUBLE)"
PR = f"""
pr0 AS (SELECT a.id AS i, b.id AS j, a.type AS ti, b.type AS tj, a.q * b.q AS qq, a.vid AS mi, b.vid AS mj, a.vx - b.vx AS wx, a.vy - b.vy AS wy, a.vz - b.vz AS wz, a.edge AS edge, a.x - b.x AS ux, a.y - b.y AS uy, a.z - b.z AS uz FROM p a JOIN p b ON a.id < b.id),
pr1 AS (SELECT *, {IMG("ux")} AS dx, {IMG("uy")} AS dy, {IMG("uz")} AS dz FROM pr0),
pr AS (SELECT *, dx * dx + dy * dy + dz * dz AS r2, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM pr1 WHERE dx * dx + dy * dy + dz * dz <= {N(RC * RC)})"""
K = N(COULOMB)
LJ = f"({N(A)} / (r2 * r2 * r2 * r2 * r2 * r2) - {N(B)} / (r2 * r2 * r2))"
LJ_F = f"((-12 * {N(A)} / (r2 * r2 * r2 * r2 * r2 * r2) + 6 * {N(B)} / (r2 * r2 * r2)) / r2)"
SW = f"(CASE WHEN r < {N(ON)} THEN 1::DOUBLE WHEN r > {N(RC)} THEN 0::DOUBLE ELSE ({N(RC * RC)} - r2) * ({N(RC * RC)} - r2) * ({N(RC * RC)} + 2 * r2 - {N(3 * ON * ON)}) / {N((RC * RC - ON * ON) ** 3)} END)"
T_ = f"(1 / (1 + {N(pot.ERFC_P)} * {N(KAPPA)} * r))"
ERFC = f"((((({N(pot.ERFC[4])} * {T_} + {N(pot.ERFC[3])}) * {T_} + {N(pot.ERFC[2])}) * {T_} + {N(pot.ERFC[1])}) * {T_} + {N(pot.ERFC[0])}) * {T_} * exp(-{N(KAPPA * KAPPA)} * r2))"
EW = f"({K} * qq * {ERFC} / r)"
RND = lambda e: f"round({e}, 4) + 0.0::DOUBLE"
ENDS = lambda rows, f: f"SELECT id, {RND('sum(fx)')} AS fx, {RND('sum(fy)')} AS fy, {RND('sum(fz)')} AS fz FROM (SELECT i AS id, -({f}) * dx AS fx, -({f}) * dy AS fy, -({f}) * dz AS fz FROM {rows} UNION ALL SELECT j, ({f}) * dx, ({f}) * dy, ({f}) * dz FROM {rows}) GROUP BY id"
CD = f"cd AS (SELECT floor(edge / {N(1.001 * RC)})::BIGINT AS cd, edge FROM g)"
CELL = lambda c: f"least(floor({c} / (p.edge / cd)), cd - 1)::BIGINT"
BIN = f"{CD}, c AS (SELECT p.*, cd, {CELL('x')} AS cx, {CELL('y')} AS cy, {CELL('z')} AS cz, ({CELL('x')} * cd + {CELL('y')}) * cd + {CELL('z')} AS cell FROM p, cd)"


def rounded(forces: DataFrame) -> DataFrame:
    return forces.select("id", *[r4(c).alias(c) for c in ("fx", "fy", "fz")])


# Particles, cells, filters


@query(f"{P} SELECT id, vid, type, q, x, y, z, vx, vy, vz FROM p")
def particles_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.unloaded(arrays.loaded(fixtures.particles(spark, sf_dir)), ("id", "vid", "type", "q", "x", "y", "z", "vx", "vy", "vz"))


@query(f"{P}, {BIN} SELECT id, cx::INT AS cx, cy::INT AS cy, cz::INT AS cz, cell FROM c")
def particles_cell_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    return binning.binned(binning.inside(ps, box), box).select("id", "cx", "cy", "cz", "cell")


@query(f"{P}, {BIN} SELECT cell, count(*) AS n FROM c GROUP BY cell")
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    return observables.cell_counts(binning.binned(ps, box))


@query(f"{P}, {BIN}, k AS (SELECT cell, count(*) AS n FROM c GROUP BY cell) SELECT a.cell, a.n, coalesce((SELECT sum(b.n) FROM k b WHERE b.cell < a.cell), 0)::BIGINT AS start FROM k a")
def cell_prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    return observables.cell_offsets(binning.binned(ps, box))


@query(f"{PD} SELECT id, x, y, z FROM p")
def particles_wrap_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.particles(spark, sf_dir, displaced=True, wrap=False)
    return binning.wrapped(raw, fixtures.box(spark, sf_dir)).select("id", "x", "y", "z")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh particle as a ghost."""
    ps = fixtures.particles(spark, sf_dir)
    return ps.where("id % 7 <> 0").unionByName(arrays.loaded(ps.where("id % 7 = 0"), ghosts=True).select(*ps.columns))


@query("SELECT o_orderkey AS id, 0::INT AS flags FROM orders WHERE o_orderkey % 7 <> 0")
def particles_filter_ghost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.flushed(flagged(spark, sf_dir), ghosts_only=True).select("id", "flags")


@query(f"{P}, {BIN} SELECT cell, count(*) AS n FROM c WHERE id % 7 <> 0 GROUP BY cell")
def particles_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observables.cell_counts(binning.binned(arrays.real(flagged(spark, sf_dir)), fixtures.box(spark, sf_dir)))


@query(f"{P} SELECT x, y, z FROM p WHERE id = 42")
def particle_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.position(fixtures.particles(spark, sf_dir), 42)


@query(f"{P} SELECT CASE type WHEN 0 THEN 'OT' ELSE 'HT' END AS name, min(type) AS type, count(*) AS n FROM p GROUP BY 1")
def type_lookup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = fixtures.types(spark)
    named = fixtures.particles(spark, sf_dir).join(types.select("type", "name"), "type").select("id", "name")
    return named.join(forcefield.type_of(types), "name").groupBy("name").agg(F.min("type").alias("type"), F.count("*").alias("n"))


@query(f"""{P}, {CD},
k AS (SELECT i.r AS cx, j.r AS cy, k.r AS cz, cd FROM cd, range(0, 60) i(r), range(0, 60) j(r), range(0, 60) k(r) WHERE i.r < cd AND j.r < cd AND k.r < cd),
near AS (SELECT (a.cx * a.cd + a.cy) * a.cd + a.cz AS ca, (((a.cx + o.r + a.cd) % a.cd) * a.cd + (a.cy + q.r + a.cd) % a.cd) * a.cd + (a.cz + s.r + a.cd) % a.cd AS cb FROM k a, range(-1, 2) o(r), range(-1, 2) q(r), range(-1, 2) s(r))
SELECT DISTINCT least(ca, cb) AS cell_a, greatest(ca, cb) AS cell_b FROM near""")
def cell_neighbor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    return binning.cell_pairs(ps, box)


# Pairs and their energies


@query(f"{P}, {PR} SELECT least(ti, tj) AS type_a, greatest(ti, tj) AS type_b, count(*) AS n, {RND('sum(r2)')} AS r2 FROM pr GROUP BY 1, 2")
def pairs_within_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    found = pairs.neighbour_pairs(ps, box)
    return found.groupBy(F.least("type_i", "type_j").alias("type_a"), F.greatest("type_i", "type_j").alias("type_b")).agg(F.count("*").alias("n"), r4(F.sum("r2")).alias("r2"))


@query(f"{P}, {PR} SELECT count(*) AS n, {RND(f'sum({LJ})')} AS e FROM pr WHERE ti = 0 AND tj = 0")
def pair_energy_lj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(oxygen_rows(spark, sf_dir), pot.lj(F.col("r2"), F.col("a"), F.col("b")))


@query(f"{P}, {PR} SELECT count(*) AS n, {RND(f'sum({LJ} * {SW})')} AS e FROM pr WHERE ti = 0 AND tj = 0")
def pair_energy_lj_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(oxygen_rows(spark, sf_dir), pot.lj_switched(F.col("r2"), F.col("a"), F.col("b"), ON, RC))


@query(f"{P}, {PR} SELECT count(*) AS n, {RND(f'sum({K} * qq / r)')} AS e FROM pr")
def pair_energy_coulomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(pair_rows(spark, sf_dir, every_type(spark)), pot.coulomb(F.col("r2"), QQ()))


@query(f"{P}, {PR} SELECT count(*) AS n, {RND(f'sum((CASE WHEN ti + tj = 0 THEN {LJ} ELSE 0 END) + {K} * qq * (1 / r - 1 / {N(RC)}))')} AS e FROM pr")
def pair_energy_lj_coulomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair_rows(spark, sf_dir, every_type(spark))
    return summed(rows, pot.lj(F.col("r2"), F.col("a"), F.col("b")) + pot.coulomb_shifted(F.col("r2"), QQ(), RC))


@query(f"{P}, {PR} SELECT count(*) AS n, {RND(f'sum({EW})')} AS e FROM pr")
def pair_energy_ewald(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(pair_rows(spark, sf_dir, every_type(spark)), pot.ewald(F.col("r2"), QQ(), KAPPA))


@query(f"{P}, {PR} SELECT count(*) AS n, {RND(f'sum((CASE WHEN ti + tj = 0 THEN {LJ} ELSE 0 END) + {EW})')} AS e FROM pr")
def pair_energy_lj_ewald(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(pair_rows(spark, sf_dir, every_type(spark)), pot.lj(F.col("r2"), F.col("a"), F.col("b")) + pot.ewald(F.col("r2"), QQ(), KAPPA))


@query(f"{P}, {PR} SELECT count(*) AS n, {RND(f'sum((CASE WHEN ti + tj = 0 THEN {LJ} * {SW} ELSE 0 END) + {EW})')} AS e FROM pr")
def pair_energy_lj_ewald_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair_rows(spark, sf_dir, every_type(spark))
    return summed(rows, pot.lj_switched(F.col("r2"), F.col("a"), F.col("b"), ON, RC) + pot.ewald(F.col("r2"), QQ(), KAPPA))


@query(f"{P}, {PR} SELECT count(*) AS n, round(sum({LJ}), 2) AS e, round(min({LJ}), 3) AS lowest, round(max({LJ}), 3) AS highest, round(sum({LJ_F}), 0) + 0.0::DOUBLE AS f FROM pr WHERE ti = 0 AND tj = 0")
def pair_energy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies and slopes of the oxygens from a fitted table; the SQL has the closed form."""
    table = tables.fitted(lambda r: A / r**12 - B / r**6, 0.2, RC + 0.01, 1e-9, lambda r: -12 * A / r**13 + 6 * B / r**7)
    rows = tables.evaluated(oxygen_rows(spark, sf_dir), table)
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("e"), 2).alias("e"), F.round(F.min("e"), 3).alias("lowest"), F.round(F.max("e"), 3).alias("highest"), (F.round(F.sum("f"), 0) + 0.0).alias("f"))


def lj_coulomb(rows: DataFrame | Mapping[str, np.ndarray]) -> pot.Term:
    """Of a joined table, or of arrays by name."""
    c = F.col if isinstance(rows, DataFrame) else rows.__getitem__
    return pot.lj(c("r2"), c("a"), c("b")) + pot.coulomb(c("r2"), c("q_i") * c("q_j"))


F_SQL = f"((CASE WHEN ti + tj = 0 THEN {LJ_F} ELSE 0 END) - {K} * qq / (r2 * r))"


def all_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair_rows(spark, sf_dir, every_type(spark))
    return pairs.both_ends(rows.withColumn("f", lj_coulomb(rows).f))


@query(f"{P}, {PR} {ENDS('pr', F_SQL)}")
def pair_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(all_forces(spark, sf_dir))


SUMS = lambda rows: f"SELECT id, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM ({rows}) GROUP BY id"
PAIR_ENDS = lambda f, where="true": f"SELECT i AS id, -({f}) * dx AS fx, -({f}) * dy AS fy, -({f}) * dz AS fz FROM pr WHERE {where} UNION ALL SELECT j, ({f}) * dx, ({f}) * dy, ({f}) * dz FROM pr WHERE {where}"


@query(f"{P}, {PR}, f AS ({SUMS(PAIR_ENDS(F_SQL))}) SELECT count(*) AS n, {RND('sum(fx)')} AS fx, {RND('sum(fy)')} AS fy, {RND('sum(fz)')} AS fz, round(sum(sqrt(fx * fx + fy * fy + fz * fz)), 3) AS size, {RND('max(fx)')} AS most FROM f")
def net_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz"))
    return all_forces(spark, sf_dir).agg(F.count("*").alias("n"), *[r4(F.sum(c)).alias(c) for c in ("fx", "fy", "fz")], F.round(F.sum(size), 3).alias("size"), r4(F.max("fx")).alias("most"))


# Bonded terms


def ends_sql(letters: str, t: str = "t") -> str:
    cols = ", ".join(f"{e}.x AS x{e}, {e}.y AS y{e}, {e}.z AS z{e}" for e in letters)
    return f"SELECT {t}.*, {letters[0]}.edge AS edge, {cols} FROM {t} " + " ".join(f"JOIN p {e} ON {e}.id = {t}.{e}" for e in letters)


def diff_sql(name: str, a: str, b: str) -> str:
    return ", ".join(f"{IMG(f'{c}{a} - {c}{b}')} AS {name}{c}" for c in "xyz")


DOT = lambda a, b: f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"
CROSS = lambda n, a, b: f"{a}y * {b}z - {a}z * {b}y AS {n}x, {a}z * {b}x - {a}x * {b}z AS {n}y, {a}x * {b}y - {a}y * {b}x AS {n}z"
BONDS = "t AS (SELECT vid * 2 + s - 1 AS bid, id AS i, id + s AS j FROM p, (VALUES (1), (2)) v(s) WHERE id % 3 = 0)"
BT = f"{PD}, {BONDS}, u AS ({ends_sql('ij')}), w AS (SELECT *, {diff_sql('d', 'i', 'j')} FROM u), bt AS (SELECT *, greatest({N(BOND_A)}, least({N(BOND_B)}, sqrt({DOT('d', 'd')}))) AS r FROM w)"
ANGLES = "t AS (SELECT vid AS aid, id + 1 AS i, id AS j, id + 2 AS k FROM p WHERE id % 3 = 0)"
AT = f"""{PD}, {ANGLES}, u0 AS ({ends_sql("ijk")}), u1 AS (SELECT *, {diff_sql("u", "i", "j")}, {diff_sql("v", "k", "j")} FROM u0),
u2 AS (SELECT *, sqrt({DOT("u", "u")}) AS nu, sqrt({DOT("v", "v")}) AS nv FROM u1), ang AS (SELECT *, {DOT("u", "v")} / (nu * nv) AS c, acos({DOT("u", "v")} / (nu * nv)) AS theta FROM u2)"""
DIHEDRALS = "t AS (SELECT vid AS did, id + 1 AS i, id AS j, id + 3 AS k, id + 5 AS l FROM p, n WHERE id % 3 = 0 AND vid % nx < nx - 1 AND id + 5 < atoms)"
#: By the textbook form in a signed angle, with f = xi - xj, g = xj - xk, h = xl - xk.
DT_ = f"""{PD}, {DIHEDRALS}, u0 AS ({ends_sql("ijkl")}), u1 AS (SELECT *, {diff_sql("f", "i", "j")}, {diff_sql("g", "j", "k")}, {diff_sql("h", "l", "k")} FROM u0),
u2 AS (SELECT *, {CROSS("a", "f", "g")}, {CROSS("w", "h", "g")} FROM u1), u3 AS (SELECT *, {CROSS("s", "w", "a")}, {DOT("a", "a")} AS a2, {DOT("w", "w")} AS b2, sqrt({DOT("g", "g")}) AS ng, {DOT("f", "g")} AS fg, {DOT("h", "g")} AS hg FROM u2),
dt AS (SELECT *, {DOT("a", "w")} / sqrt(a2 * b2) AS cosphi, atan2({DOT("s", "g")} / ng, {DOT("a", "w")}) AS phi FROM u3)"""


def bond_pot(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, 1 - i, BOND_K, BOND_R0, BOND_A, BOND_B) for i in (0, 1)], "type_i int, type_j int, k double, r0 double, a double, b double")


def bond_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir, True)
    return bonded.bond_terms(fixtures.bonds(ps), ps, bond_pot(spark), box)


@query(f"{BT} SELECT count(*) AS n, {RND(f'sum({N(BOND_K)} * (r - {N(BOND_R0)}) * (r - {N(BOND_R0)}))')} AS e FROM bt")
def bond_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bond_rows(spark, sf_dir).agg(F.count("*").alias("n"), r4(F.sum("e")).alias("e"))


@query(f"{BT} {ENDS('bt', f'2 * {N(BOND_K)} * (r - {N(BOND_R0)}) / r')}")
def bond_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bonded.bond_forces(bond_rows(spark, sf_dir)))


def angle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir, True)
    return bonded.angle_terms(fixtures.angles(ps), ps, box, ANGLE_K, THETA0)


@query(f"{AT} SELECT count(*) AS n, {RND(f'sum({N(ANGLE_K)} * (theta - {N(THETA0)}) * (theta - {N(THETA0)}))')} AS e FROM ang")
def angle_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angle_rows(spark, sf_dir).agg(F.count("*").alias("n"), r4(F.sum("e")).alias("e"))


S_ANGLE = f"(2 * {N(ANGLE_K)} * (theta - {N(THETA0)}) / sin(theta))"
SPREAD = lambda rows, parts: "SELECT id, " + ", ".join(f"{RND(f'sum(f{c})')} AS f{c}" for c in "xyz") + " FROM (" + " UNION ALL ".join(f"SELECT {e} AS id, {g.format(c='x')} AS fx, {g.format(c='y')} AS fy, {g.format(c='z')} AS fz FROM {rows}" for e, g in parts.items()) + ") GROUP BY id"
ANGLE_I = S_ANGLE + " * (v{c} / (nu * nv) - c * u{c} / (nu * nu))"
ANGLE_K_ = S_ANGLE + " * (u{c} / (nu * nv) - c * v{c} / (nv * nv))"


@query(f"{AT} {SPREAD('ang', {'i': ANGLE_I, 'k': ANGLE_K_, 'j': f'-({ANGLE_I}) - ({ANGLE_K_})'})}")
def angle_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bonded.angle_forces(angle_rows(spark, sf_dir)))


def dihedral_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir, True)
    return bonded.dihedral_terms(fixtures.dihedrals(ps, ps.count()), ps, box, DIH_K, DIH_N, 0.0)


@query(f"{DT_} SELECT count(*) AS n, {RND('min(cosphi)')} AS lo, {RND('max(cosphi)')} AS hi, {RND(f'sum({N(DIH_K)} * (1 + cos({DIH_N} * phi)))')} AS e FROM dt")
def dihedral_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dihedral_rows(spark, sf_dir).agg(F.count("*").alias("n"), r4(F.min("cosphi")).alias("lo"), r4(F.max("cosphi")).alias("hi"), r4(F.sum("e")).alias("e"))


@query(f"{DT_} SELECT count(*) AS n, {RND(f'sum({N(DIH_K)} * (acos(cosphi) - 1.9::DOUBLE) * (acos(cosphi) - 1.9::DOUBLE))')} AS e FROM dt")
def improper_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = pot.improper_energy(F.col("cosphi"), DIH_K, 1.9)
    return dihedral_rows(spark, sf_dir).agg(F.count("*").alias("n"), r4(F.sum(e)).alias("e"))


S_DIH = f"({N(DIH_K * DIH_N)} * sin({DIH_N} * phi))"  # minus dE/dphi
DIH_I, DIH_L = "(-ng / a2 * a{c})", "(ng / b2 * w{c})"
DIH_MID = "(fg / (a2 * ng) * a{c} - hg / (b2 * ng) * w{c})"


@query(f"{DT_} {SPREAD('dt', {'i': S_DIH + ' * ' + DIH_I, 'l': S_DIH + ' * ' + DIH_L, 'j': f'{S_DIH} * ({DIH_MID} - {DIH_I})', 'k': f'-{S_DIH} * ({DIH_MID} + {DIH_L})'})}")
def dihedral_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bonded.dihedral_forces(dihedral_rows(spark, sf_dir)))


# Exclusions


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = fixtures.particles(spark, sf_dir)
    twice = fixtures.bonds(ps).select(F.col("j").alias("i"), F.col("i").alias("j"))
    return pairs.exclusions_of(fixtures.bonds(ps).unionByName(twice, allowMissingColumns=True), fixtures.angles(ps))


@query("SELECT a.o_orderkey AS i, b.o_orderkey AS j FROM orders a JOIN orders b ON a.o_orderkey // 3 = b.o_orderkey // 3 AND a.o_orderkey < b.o_orderkey")
def exclusion_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclusions(spark, sf_dir)


@query(f"{P}, {DIHEDRALS} SELECT a.o_orderkey AS i, b.o_orderkey AS j FROM orders a JOIN orders b ON a.o_orderkey // 3 = b.o_orderkey // 3 AND a.o_orderkey < b.o_orderkey UNION SELECT i, l FROM t")
def exclusions_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From bonds, angles, dihedrals and constraints."""
    ps = fixtures.particles(spark, sf_dir)
    return pairs.exclusions_of(fixtures.bonds(ps), fixtures.angles(ps), fixtures.dihedrals(ps, ps.count()), rigid_edges(spark, sf_dir))


EX_E = f"((CASE WHEN ti + tj = 0 THEN {LJ} ELSE 0 END) + {K} * qq / r)"


@query(f"{P}, {PR} SELECT count(*) AS n, {RND(f'-sum({EX_E})')} AS e FROM pr WHERE mi = mj")
def exclusion_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    charged = ps.select("id", "q")
    listed = exclusions(spark, sf_dir)
    for e in "ij":
        listed = listed.join(charged.select(F.col("id").alias(e), F.col("q").alias(f"q_{e}")), e)
    return bonded.excluded_terms(listed, ps, every_type(spark), box, lj_coulomb).agg(F.count("*").alias("n"), r4(F.sum("e")).alias("e"))


def kept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    rows = pairs.with_potential(pairs.neighbour_pairs(ps, box, exclusions=exclusions(spark, sf_dir)), every_type(spark))
    t = lj_coulomb(rows)
    return rows.withColumns({"e": t.e, "f": t.f})


@query(f"{P}, {PR} SELECT count(*) AS n, {RND(f'sum({EX_E})')} AS e FROM pr WHERE mi <> mj")
def nonbonded_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_pairs(spark, sf_dir).agg(F.count("*").alias("n"), r4(F.sum("e")).alias("e"))


def renamed(sql: str, mark: str) -> str:
    """The steps of a query after the particles, under names of their own."""
    return re.sub(r"\b(t|u|u0|u1|u2|u3|w)\b", lambda m: f"{m.group()}_{mark}", sql[len(PD) + 2 :])


#: All interactions of the displaced water: pairs pr, bonds bt, angles ang, dihedrals dt.
ALL = f"{PD}, {PR}, {renamed(BT, 'b')}, {renamed(AT, 'a')}, {renamed(DT_, 'd')}"
E_BOND, E_ANGLE, E_DIH = f"{N(BOND_K)} * (r - {N(BOND_R0)}) * (r - {N(BOND_R0)})", f"{N(ANGLE_K)} * (theta - {N(THETA0)}) * (theta - {N(THETA0)})", f"{N(DIH_K)} * (1 + cos({DIH_N} * phi))"


@query(f"""{ALL}, e AS (SELECT 'nonbond' AS term, sum({EX_E}) AS e FROM pr UNION ALL SELECT 'exclusion', -sum({EX_E}) FROM pr WHERE mi = mj UNION ALL SELECT 'bond', sum({E_BOND}) FROM bt
UNION ALL SELECT 'angle', sum({E_ANGLE}) FROM ang UNION ALL SELECT 'dihedral', sum({E_DIH}) FROM dt)
SELECT term, {RND("e")} AS value FROM e UNION ALL SELECT 'total', {RND("sum(e)")} FROM e""")
def energy_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir, True)
    rows = pairs.with_potential(pairs.neighbour_pairs(ps, box), every_type(spark))
    listed = exclusions(spark, sf_dir)
    for e in "ij":
        listed = listed.join(ps.select(F.col("id").alias(e), F.col("q").alias(f"q_{e}")), e)
    found = observables.breakdown(
        nonbond=rows.withColumn("e", lj_coulomb(rows).e), exclusion=bonded.excluded_terms(listed, ps, every_type(spark), box, lj_coulomb),
        bond=bond_rows(spark, sf_dir), angle=angle_rows(spark, sf_dir), dihedral=dihedral_rows(spark, sf_dir),
    )
    return found.select("term", r4("value").alias("value"))


# Observables


def massed(spark: SparkSession, sf_dir: str, displaced: bool = False) -> DataFrame:
    return observables.massed(fixtures.particles(spark, sf_dir, displaced), fixtures.types(spark))


EK = "sum(0.5::DOUBLE * m * (vx * vx + vy * vy + vz * vz))"


@query(f"{P} SELECT count(*) AS n, {RND(EK)} AS ekin FROM p")
def kinetic_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observables.kinetic(massed(spark, sf_dir)).select("n", r4("ekin").alias("ekin"))


FS = f"fs AS (SELECT id, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM (SELECT i AS id, -{F_SQL} * dx AS fx, -{F_SQL} * dy AS fy, -{F_SQL} * dz AS fz FROM pr WHERE mi <> mj UNION ALL SELECT j, {F_SQL} * dx, {F_SQL} * dy, {F_SQL} * dz FROM pr WHERE mi <> mj) GROUP BY id)"


@query(f"{P}, {PR}, {FS}, h AS (SELECT m, " + ", ".join(f"v{c} - {N(DT / 2)} * coalesce(f{c}, 0) / m AS v{c}" for c in "xyz") + f" FROM p LEFT JOIN fs USING (id)) SELECT count(*) AS n, {RND(EK)} AS ekin FROM h")
def kinetic_energy_half_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    forces = pairs.both_ends(kept_pairs(spark, sf_dir))
    return observables.kinetic_half_step(massed(spark, sf_dir), forces, DT).select("n", r4("ekin").alias("ekin"))


@query(f"{P} SELECT {RND(EK)} AS ekin, {RND(f'2 * {EK} / ({N(GAS)} * (3 * count(*) - count(*)))')} AS temperature FROM p")
def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = massed(spark, sf_dir)
    return observables.temperature(rows, constraints=rows.count()).select(r4("ekin").alias("ekin"), r4("temperature").alias("temperature"))


@query(f"{P} SELECT {RND('sum(m)')} AS mass, " + ", ".join(f"{RND(f'sum(m * v{c})')} AS p{c}" for c in "xyz") + ", " + ", ".join(f"{RND(f'sum(m * v{c}) / sum(m)')} AS com_v{c}" for c in "xyz") + " FROM p")
def com_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observables.com_velocity(massed(spark, sf_dir))
    return found.select(*[r4(c).alias(c) for c in found.columns])


@query(f"{P}, w AS (SELECT vid, sum(m) AS m, sum(m * vx) / sum(m) AS vx, sum(m * vy) / sum(m) AS vy, sum(m * vz) / sum(m) AS vz FROM p GROUP BY vid) SELECT count(*) AS molecules, {RND(EK)} AS ekin, {RND(f'2 * {EK} / (3 * {N(GAS)} * count(*))')} AS temperature FROM w")
def molecular_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observables.molecular_temperature(massed(spark, sf_dir)).select("molecules", r4("ekin").alias("ekin"), r4("temperature").alias("temperature"))


MOVED = f"""{P}, s AS (SELECT o_orderkey AS id, {", ".join(f"((o_orderkey * {k}) % 8) / 512e0 AS d{c}" for c, k in zip("xyz", (13, 29, 43), strict=True))} FROM orders),
mx AS (SELECT max(sqrt(dx * dx + dy * dy + dz * dz)) AS m FROM s)"""


@query(f"{MOVED} SELECT {RND('m')} AS maxdx FROM mx")
def max_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, box = water(spark, sf_dir, True)
    return observables.max_displacement(now, fixtures.particles(spark, sf_dir), box).select(r4("maxdx").alias("maxdx"))


@query(f"{MOVED} SELECT {RND('m')} AS maxdx, (2 * m > {N(SKIN)} OR m > {N(0.25 * RC)}) AS rebuild FROM mx")
def verlet_rebuild_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, box = water(spark, sf_dir, True)
    moved = observables.max_displacement(now, fixtures.particles(spark, sf_dir), box)
    return observables.rebuild_needed(moved, SKIN, RC).select(r4("maxdx").alias("maxdx"), "rebuild")


@query(f"""{P}, {BIN}, k AS (SELECT cx, cy, cz, cell, cd, count(*) AS n FROM c GROUP BY ALL),
w AS (SELECT a.cell, sum(a.n * b.n * CASE abs(o.r) + abs(q.r) + abs(s.r) WHEN 1 THEN {N(0.50004)} WHEN 2 THEN {N(0.16176)} ELSE {N(0.036213)} END) AS s
FROM k a, range(-1, 2) o(r), range(-1, 2) q(r), range(-1, 2) s(r), k b WHERE abs(o.r) + abs(q.r) + abs(s.r) > 0 AND b.cx = (a.cx + o.r + a.cd) % a.cd AND b.cy = (a.cy + q.r + a.cd) % a.cd AND b.cz = (a.cz + s.r + a.cd) % a.cd GROUP BY a.cell)
SELECT cell, n, round(n * n - n + coalesce(s, 0), 6) AS weight FROM k LEFT JOIN w USING (cell)""")
def partition_load_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    return observables.load_weights(binning.binned(ps, box), box).select("cell", "n", F.round("weight", 6).alias("weight"))


# Steps


@query(f"{P}, {PR}, {FS}, v1 AS (SELECT id, edge, x, y, z, " + ", ".join(f"v{c} + {N(DT)} * coalesce(f{c}, 0) / m AS v{c}" for c in "xyz") + " FROM p LEFT JOIN fs USING (id)), x1 AS (SELECT id, vx, vy, vz, edge, " + ", ".join(f"{c} + {N(DT)} * v{c} AS {c}" for c in "xyz") + f" FROM v1) SELECT id, {RND('x - edge * floor(x / edge)')} AS x, {RND('y - edge * floor(y / edge)')} AS y, {RND('z - edge * floor(z / edge)')} AS z, {RND('vx')} AS vx, {RND('vy')} AS vy, {RND('vz')} AS vz FROM x1")
def integrate_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    forces = pairs.both_ends(kept_pairs(spark, sf_dir))
    moved = integrate.advanced(massed(spark, sf_dir), forces, DT, fixtures.box(spark, sf_dir))
    return moved.select("id", *[r4(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])


@query(f"{P}, t AS (SELECT 2 * {EK} / (3 * {N(GAS)} * count(*)) AS t FROM p), w AS (SELECT sqrt(1 + 0.1::DOUBLE * (300 / t - 1)) AS w FROM t) SELECT id, {RND('vx * w')} AS vx, {RND('vy * w')} AS vy, {RND('vz * w')} AS vz FROM p, w")
def thermostat_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = massed(spark, sf_dir)
    return integrate.thermostat(rows, observables.temperature(rows), 300.0, 0.1).select("id", *[r4(c).alias(c) for c in ("vx", "vy", "vz")])


@query(f"{P}, s AS (SELECT *, least(1::DOUBLE, 0.5::DOUBLE / nullif(sqrt(vx * vx + vy * vy + vz * vz), 0)) AS w FROM p) SELECT id, {RND('vx * coalesce(w, 1)')} AS vx, {RND('vy * coalesce(w, 1)')} AS vy, {RND('vz * coalesce(w, 1)')} AS vz FROM s")
def velocity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.capped(fixtures.particles(spark, sf_dir), 0.5).select("id", *[r4(c).alias(c) for c in ("vx", "vy", "vz")])


DPD_A, DPD_G, DPD_SEED = 25.0, 4.5, 7


def poly_sql(x: str, factors: tuple[float, ...]) -> str:
    out = N(factors[0])
    for c in factors[1:]:
        out = f"({out} * {x} + {N(c)})"
    return out


def noise_sql(rows: str, seed: int, step: int = 0) -> str:
    """CTEs to zz: rows with z, a normal number of each pair."""
    p, o, f = integrate.PRIME, integrate.OTHER, integrate.FACTORS
    tail = f"{poly_sql('t', integrate.NORMAL_C)} / {poly_sql('t', integrate.NORMAL_D)}"
    return f"""n1 AS (SELECT *, least(i, j) % {p} AS lo, greatest(i, j) % {p} AS hi FROM {rows}), n2 AS (SELECT *, (lo * {f[0]} + hi * {f[1]} + {(seed * 1000003 + step) % p * f[2]}) % {p} AS na FROM n1),
n3 AS (SELECT *, (na * na) % {o} AS nb FROM n2), n4 AS (SELECT *, (nb * {f[3]} + hi * {f[4]} + lo) % {p} AS nc FROM n3), n5 AS (SELECT *, (((nc * nc) % {o} * {f[5]} + nb) % {p} + 0.5::DOUBLE) / {p}::DOUBLE AS u FROM n4),
n6 AS (SELECT *, sqrt(-2 * ln(least(u, 1 - u))) AS t, u - 0.5::DOUBLE AS h, (u - 0.5::DOUBLE) * (u - 0.5::DOUBLE) AS h2 FROM n5),
zz AS (SELECT *, CASE WHEN u < {N(integrate.NORMAL_LOW)} THEN {tail} WHEN u > {N(1.0 - integrate.NORMAL_LOW)} THEN -({tail}) ELSE h * {poly_sql('h2', integrate.NORMAL_A)} / {poly_sql('h2', integrate.NORMAL_B)} END AS z, 1 - r / {N(RC)} AS w FROM n6)"""


def dpd_sql(rows: str, step: int = 0) -> str:
    return f"{noise_sql(rows, DPD_SEED, step)}, dp AS (SELECT *, -((-{N(DPD_G)} * w * (dx * wx + dy * wy + dz * wz) / r + {N(math.sqrt(2.0 / DT))} * z) * {N(DPD_G)} + {N(DPD_A)}) * w / r AS ff FROM zz) {ENDS('dp', 'ff')}"


@query(f"{P}, {PR}, {dpd_sql('pr')}")
def dpd_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    return rounded(pairs.both_ends(integrate.dpd_pairs(ps, box, DPD_A, DPD_G, DT, DPD_SEED)))


PR2 = PR.replace("FROM p a JOIN p b", "FROM p2 a JOIN p2 b").replace("pr0", "qr0").replace("pr1", "qr1").replace("pr AS", "qr AS")


@query(f"{P}, {PR}, {FS}, p2 AS (SELECT p.* EXCLUDE (vx, vy, vz), " + ", ".join(f"v{c} + {N(DT / 2)} * coalesce(f{c}, 0) / m AS v{c}" for c in "xyz") + f" FROM p LEFT JOIN fs USING (id)), {PR2}, {dpd_sql('qr', 3)}")
def dpd_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dissipative forces of a run's third step, on velocities half a step on."""
    rows = integrate.projected(massed(spark, sf_dir), pairs.both_ends(kept_pairs(spark, sf_dir)), DT)
    return rounded(pairs.both_ends(integrate.dpd_pairs(rows, fixtures.box(spark, sf_dir), DPD_A, DPD_G, DT, DPD_SEED, 3)))


# Rigid groups


def rigid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three constraints a molecule, at the fixture's own distances."""
    ps, box = water(spark, sf_dir)
    ends = fixtures.bonds(ps).select("i", "j").union(fixtures.angles(ps).select("i", F.col("k").alias("j")))
    rows = bonded.named(bonded.placed(ends, ps, "ij"), d=bonded.between("i", "j", box))
    return rows.select("i", "j", bonded.dot(bonded.vec("d"), bonded.vec("d")).alias("d2"))


@query("SELECT o_orderkey AS id, o_orderkey - o_orderkey % 3 AS rid FROM orders")
def rigid_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = fixtures.particles(spark, sf_dir)
    ends = fixtures.bonds(ps).select("i", "j").union(fixtures.angles(ps).select("i", F.col("k").alias("j")))
    return constraints.groups(ends)


def free_step(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The water, and the water after a step without forces."""
    rows = massed(spark, sf_dir)
    return rows, rows.withColumns({c: F.col(c) + DT * F.col(v) for c, v in zip("xyz", ("vx", "vy", "vz"), strict=True)})


def constrained_step(spark: SparkSession, sf_dir: str, preconditioned: bool) -> DataFrame:
    """A free step of the water, put back on its constraints: their squared lengths, and each molecule's momentum."""
    before, after = free_step(spark, sf_dir)
    box = fixtures.box(spark, sf_dir)
    edges = rigid_edges(spark, sf_dir).select(F.floor(F.col("i") / 3).alias("rid"), "i", "j", "d2")
    found = settled(integrate.constrained(after, before, edges, box, DT, preconditioned))
    lengths = bonded.named(bonded.placed(edges, found, "ij"), d=bonded.between("i", "j", box))
    d2 = lengths.groupBy("rid").agg(*[F.round(f(bonded.dot(bonded.vec("d"), bonded.vec("d"))), 6).alias(n) for f, n in ((F.sum, "d2"), (F.max, "longest"))])
    momentum = found.groupBy(F.col("vid").alias("rid")).agg(*[r4(F.sum(F.col("m") * F.col(f"v{c}"))).alias(f"p{c}") for c in "xyz"], r4(F.sum(F.col("m") * F.col("z"))).alias("mz"))
    return momentum.join(d2, "rid")


#: A constraint's length stays what it was, a molecule's momentum too, and its centre of mass moves as if it were free.
SHAKEN = f"""{P}, l AS (SELECT a.vid AS rid, a.edge, a.x - b.x AS ux, a.y - b.y AS uy, a.z - b.z AS uz FROM p a JOIN p b ON a.vid = b.vid AND a.id < b.id), l1 AS (SELECT rid, {IMG("ux")} AS dx, {IMG("uy")} AS dy, {IMG("uz")} AS dz FROM l),
l2 AS (SELECT rid, round(sum(dx * dx + dy * dy + dz * dz), 6) AS d2, round(max(dx * dx + dy * dy + dz * dz), 6) AS longest FROM l1 GROUP BY rid)
SELECT vid AS rid, {RND("sum(m * vx)")} AS px, {RND("sum(m * vy)")} AS py, {RND("sum(m * vz)")} AS pz, {RND(f"sum(m * (z + {N(DT)} * vz))")} AS mz, any_value(d2) AS d2, any_value(longest) AS longest FROM p JOIN l2 ON vid = rid GROUP BY vid"""


@query(SHAKEN)
def shake_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constrained_step(spark, sf_dir, False)


@query(SHAKEN)
def pshake_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constrained_step(spark, sf_dir, True)


@query("SELECT count(*) * 3 AS constraints, count(*) AS groups, count(*) * 3 AS parts FROM orders WHERE o_orderkey % 3 = 0")
def constraint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.counted(rigid_edges(spark, sf_dir))


@query("SELECT o_orderkey AS i, o_orderkey + s AS j, CASE s WHEN 1 THEN 4::DOUBLE ELSE 2::DOUBLE END AS d2 FROM orders, (VALUES (1), (2)) v(s) WHERE o_orderkey % 3 = 0")
def constraints_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint given again, the other way round, takes its last length."""
    o = fixtures.particles(spark, sf_dir).where("id % 3 = 0")
    row = lambda i, j, d2: F.struct(i.alias("i"), j.alias("j"), F.lit(d2).alias("d2"))
    some = o.select(F.explode(F.array(row(F.col("id"), F.col("id") + 1, 1.0), row(F.col("id"), F.col("id") + 2, 2.0))).alias("e")).select("e.*")
    return constraints.added(some, o.select((F.col("id") + 1).alias("i"), F.col("id").alias("j"), F.lit(4.0).alias("d2")))


# Force field


@query(f"SELECT ti AS type_i, tj AS type_j, round(sqrt(ei * ej) * pow(ri + rj, 12) * 1e9, 4) AS a_e9, round(2 * sqrt(ei * ej) * pow(ri + rj, 6) * 1e6, 4) AS b_e6, round(qi * qj, 4) AS qq FROM (VALUES (0, 0.6364::DOUBLE, 0.1776::DOUBLE, -0.8476::DOUBLE), (1, 0.1924::DOUBLE, 0.0225::DOUBLE, 0.4238::DOUBLE)) a(ti, ei, ri, qi), (VALUES (0, 0.6364::DOUBLE, 0.1776::DOUBLE, -0.8476::DOUBLE), (1, 0.1924::DOUBLE, 0.0225::DOUBLE, 0.4238::DOUBLE)) b(tj, ej, rj, qj)")
def combine_lj_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forcefield.combined(fixtures.types(spark))
    return found.select("type_i", "type_j", F.round(F.col("a") * 1e9, 4).alias("a_e9"), F.round(F.col("b") * 1e6, 4).alias("b_e6"), F.round("qq", 4).alias("qq"))


@query(f"WITH e AS (SELECT {N(forcefield.lj_minimum(A, B))} AS r0), s AS (SELECT r0 / 2 + k * 1e-6 AS r, r0 FROM e, range(0, 200000) t(k) WHERE r0 / 2 + k * 1e-6 <= r0) SELECT 'lj' AS kind, round(min(r) FILTER (WHERE abs({N(A)} / pow(r, 12) - {N(B)} / pow(r, 6)) < 2 * abs({N(A)} / pow(r0, 12) - {N(B)} / pow(r0, 6))), 3) AS a FROM s")
def inner_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = forcefield.inner_radius(lambda r: A / r**12 - B / r**6, forcefield.lj_minimum(A, B))
    return spark.createDataFrame([("lj", round(a, 3))], "kind string, a double")


def named_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.particles(spark, sf_dir).join(fixtures.types(spark).select("type", "name"), "type").select("id", "name")


def bond_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("HT", "OT", 1, 100.0, 0.2), ("OT", "HT", 5, BOND_K, BOND_R0), ("OT", "OT", 9, 1.0, 1.0)], "t1 string, t2 string, line int, force double, r0 double")


BP = "v AS (SELECT o_orderkey AS o FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"{BP} SELECT 2 * (o // 3) + s - 1 AS bid, o AS i, o + s AS j, {N(BOND_K)} AS force, {N(BOND_R0)} AS r0 FROM v, (VALUES (1), (2)) w(s)")
def assign_bond_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = fixtures.particles(spark, sf_dir)
    return forcefield.assigned_bonds(fixtures.bonds(ps), named_water(spark, sf_dir), bond_params(spark)).select("bid", "i", "j", "force", "r0")


@query(f"{BP} SELECT o // 3 AS aid, {N(ANGLE_K)} AS force, {N(THETA0)} AS theta0 FROM v")
def assign_angle_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = fixtures.particles(spark, sf_dir)
    params = spark.createDataFrame([("HT", "OT", "HT", 1, 1.0, 2.0), ("HT", "OT", "HT", 2, ANGLE_K, THETA0), ("OT", "HT", "HT", 3, 9.0, 9.0)], "t1 string, t2 string, t3 string, line int, force double, theta0 double")
    found = forcefield.assigned_angles(fixtures.angles(ps).drop("pid"), named_water(spark, sf_dir), params)
    return found.select("aid", "force", "theta0")


@query(f"{P} SELECT vid AS did, 0.2::DOUBLE AS force, 3::INT AS n FROM p, n WHERE id % 3 = 0 AND vid % nx < nx - 1 AND id + 5 < atoms")
def assign_dihedral_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = fixtures.particles(spark, sf_dir)
    params = spark.createDataFrame([("OT", "OT", "OT", "OT", 1, 9.0, 1), ("X", "OT", "OT", "X", 2, 0.2, 3), ("HT", "OT", "OT", "HT", 3, 7.0, 2)], "t1 string, t2 string, t3 string, t4 string, line int, force double, n int")
    return forcefield.assigned_dihedrals(fixtures.dihedrals(ps, ps.count()), named_water(spark, sf_dir), params).select("did", "force", "n")


@query(f"{BP} SELECT 2 * (o // 3) + s - 1 AS bid, o AS i, o + s AS j, {N(BOND_R0)} AS d FROM v, (VALUES (1), (2)) w(s)")
def split_rigid_hydrogens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = fixtures.particles(spark, sf_dir)
    rigid, rest = forcefield.split_hydrogens(forcefield.assigned_bonds(fixtures.bonds(ps), named_water(spark, sf_dir), bond_params(spark)))
    return rigid.unionByName(rest.select("bid", "i", "j", F.col("r0").alias("d")))


@query(f"{BP} SELECT o // 3 AS aid FROM v")
def missing_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = fixtures.particles(spark, sf_dir)
    params = spark.createDataFrame([("HT", "HT", "OT", 1, 1.0, 2.0)], "t1 string, t2 string, t3 string, line int, force double, theta0 double")
    return forcefield.missing(forcefield.assigned_angles(fixtures.angles(ps).drop("pid"), named_water(spark, sf_dir), params), "theta0").select("aid")


# Files


PSF = """PSF

       1 !NTITLE
 REMARKS a small molecule

       4 !NATOM
       1 W    1    WAT  OH2  OT    -0.834000       15.9994           0
       2 W    1    WAT  H1   HT     0.417000        1.0080           0
       3 W    1    WAT  H2   HT     0.417000        1.0080           0
       4 W    2    WAT  OH2  OT    -0.834000       15.9994           0

       2 !NBOND: bonds
       1       2       1       3

       1 !NTHETA: angles
       2       1       3

       1 !NPHI: dihedrals
       2       1       3       4

       0 !NIMPHI: impropers

"""
PDB = """REMARK made for a test
ATOM 1 OH2 WAT 1 1.000 2.000 3.000 1.00 0.00 W
ATOM 2 H1 WAT 1 1.957 2.000 -3.000 1.00 0.00 W
ATOM 3 H2 WAT 1 0.760 2.927 3.000 1.00 0.00 W
ATOM 4 OH2 WAT 2 11.000 2.000 3.000 1.00 0.00 W
END
"""
CHARMM = """* a small file
BONDS
OT HT 450.0 0.9572 ! bond
ANGLES
HT OT HT 55.0 104.52
DIHEDRALS
X OT OT X 0.2 3 0.0
IMPROPER
HT X X OT 10.0 0 180.0
NONBONDED nbxmod 5 atom
OT 0.0 -0.1521 1.7682
HT 0.0 -0.046 0.2245
HBOND
END
"""
XPLOR = """REMARK a small file
BOND OT HT 450.0 0.9572 { bond }
angle HT OT HT 55.0 104.52
DIHE X OT OT X 0.2 3 0.0
IMPR HT X X OT 10.0 0 180.0 ! improper
NONB OT 0.1521 3.5364 0.1 3.0
NBFIX OT HT 1 2 3 4
"""


def sample(spark: SparkSession, name: str, text: str) -> str:
    """A small file of our own in the shared folder, under a name of its own."""
    path = f"{shared_folder(spark)}/lattica-samples/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    return path


@query("SELECT * FROM (VALUES (0::BIGINT, 'OT', 0::INT, -0.834::DOUBLE, 15.9994::DOUBLE), (1, 'HT', 1, 0.417, 1.008), (2, 'HT', 1, 0.417, 1.008), (3, 'OT', 0, -0.834, 15.9994)) t(id, name, type, q, m)")
def psf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.read_psf(spark, sample(spark, "psf", PSF)).atoms.select("id", "name", "type", "q", "m")


@query("SELECT * FROM (VALUES ('angle', '1,0,2'), ('bond', '0,1'), ('bond', '0,2'), ('dihedral', '1,0,2,3')) t(kind, ends)")
def psf_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = structure.read_psf(spark, sample(spark, "psf", PSF))
    of = lambda df, kind, ends: df.select(F.lit(kind).alias("kind"), F.concat_ws(",", *ends).alias("ends"))
    return of(top.bonds, "bond", "ij").union(of(top.angles, "angle", "ijk")).union(of(top.dihedrals, "dihedral", "ijkl"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'OH2', 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE), (1, 'H1', 0.1957, 0.2, 0.7), (2, 'H2', 0.076, 0.2927, 0.3), (3, 'OH2', 0.1, 0.2, 0.3)) t(n, name, x, y, z)")
def pdb_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = Box((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), 0.3)
    return structure.read_pdb(spark, sample(spark, "pdb", PDB), box).select("n", "name", *[r4(c).alias(c) for c in "xyz"])


def told(p: parameters.Parameters) -> DataFrame:
    """All parameters as (kind, names, v1, v2)."""
    of = lambda df, kind, n, a, b: df.select(F.lit(kind).alias("kind"), F.concat_ws("-", *[f"t{k + 1}" for k in range(n)]).alias("names"), r4(a).alias("v1"), r4(b).alias("v2"))
    out = of(p.bonds, "bond", 2, "force", "r0").union(of(p.angles, "angle", 3, "force", "theta0")).union(of(p.dihedrals, "dihedral", 4, "force", "n"))
    return out.union(of(p.impropers, "improper", 4, "force", "psi0")).union(of(p.nonbonded, "nonbonded", 1, "eps", "rmin"))


@query("SELECT * FROM (VALUES ('bond', 'OT-HT', 188280.0::DOUBLE, 0.0957::DOUBLE), ('angle', 'HT-OT-HT', 230.12, 1.8242), ('dihedral', 'X-OT-OT-X', 0.8368, 3.0), ('improper', 'HT-X-X-OT', 41.84, 3.1416), ('nonbonded', 'OT', 0.6364, 0.1768), ('nonbonded', 'HT', 0.1925, 0.0225)) t(kind, names, v1, v2)")
def charmm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(parameters.read_charmm(spark, sample(spark, "charmm", CHARMM)))


@query("SELECT * FROM (VALUES ('bond', 'OT-HT', 188280.0::DOUBLE, 0.0957::DOUBLE), ('angle', 'HT-OT-HT', 230.12, 1.8242), ('dihedral', 'X-OT-OT-X', 0.8368, 3.0), ('improper', 'HT-X-X-OT', 41.84, 3.1416), ('nonbonded', 'OT', 0.6364, 0.1768)) t(kind, names, v1, v2)")
def xplor_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(parameters.read_xplor(spark, sample(spark, "xplor", XPLOR)))


@query(f"{P} SELECT id, printf('ATOM  %5d %-4s X %4d %11.3f %11.3f %11.3f', (id + 1) % 100000, 'OT', (vid + 1) % 10000, x * 10, y * 10, z * 10) AS line FROM p WHERE type = 0")
def pdb_dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = fixtures.particles(spark, sf_dir).join(fixtures.types(spark).select("type", "name"), "type")
    return structure.pdb_lines(ps, ("HT",))


# Long range


W4 = lambda u: f"(CASE WHEN {u} <= 0 OR {u} >= 4 THEN 0 WHEN {u} < 1 THEN {u} * {u} * {u} / 6 WHEN {u} < 2 THEN (((-3 * {u} + 12) * {u} - 12) * {u} + 4) / 6 WHEN {u} < 3 THEN (((3 * {u} - 24) * {u} + 60) * {u} - 44) / 6 ELSE (4 - {u}) * (4 - {u}) * (4 - {u}) / 6 END)"
#: Points along an edge: the smallest product of 2, 3 and 5 that is fine enough.
MESH = f"ms AS (SELECT min(n) AS gn FROM (SELECT (pow(2, a.r) * pow(3, b.r) * pow(5, c.r))::BIGINT AS n FROM range(0, 12) a(r), range(0, 8) b(r), range(0, 6) c(r)), g WHERE n >= {2 * longrange.ORDER} AND n >= edge * {N(KAPPA)} / {N(longrange.SPACING)})"


@query(f"""{P}, {MESH}, s AS (SELECT q, gn, {", ".join(f"{c} * (gn / edge) AS u{c}" for c in "xyz")} FROM p, ms),
k AS (SELECT q, {", ".join(f"((floor(u{c})::BIGINT - {c}k.r + gn) % gn)::INT AS g{c}, {W4(f'(u{c} - floor(u{c}) + {c}k.r)')} AS w{c}" for c in "xyz")} FROM s, range(0, 4) xk(r), range(0, 4) yk(r), range(0, 4) zk(r))
SELECT gx, gy, gz, {RND("sum(q * wx * wy * wz)")} AS q FROM k GROUP BY gx, gy, gz""")
def spme_charge_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charge on every point of the grid."""
    ps, box = water(spark, sf_dir)
    return longrange.spread(ps, box, longrange.mesh(box, KAPPA)).select("gx", "gy", "gz", r4("q").alias("q"))


@query()
def spme_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    grid = longrange.mesh(box, KAPPA)
    return longrange.mesh_energy(longrange.transformed(ps, box, grid), box, grid, KAPPA).select(r4("e").alias("e"))


@query()
def spme_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps, box = water(spark, sf_dir)
    grid = longrange.mesh(box, KAPPA)
    phi = longrange.potential(longrange.transformed(ps, box, grid), box, grid, KAPPA)
    return rounded(longrange.mesh_forces(ps, phi, box, grid))


# Inserts, unloads, lookups


@query("SELECT o_orderkey AS id, (o_orderkey // 3)::BIGINT AS vid, 0::INT AS flags FROM orders")
def particles_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = arrays.loaded(fixtures.particles(spark, sf_dir))
    return arrays.added(ps.where("id % 50 <> 0"), ps.where("id % 50 = 0").drop("flags", "q")).select("id", "vid", "flags")


@query(f"{P}, {PR}, {CD} SELECT (SELECT count(*) FROM p) AS n, count(*) AS pairs, {RND(f'sum({EX_E})')} AS epot FROM pr")
def unload_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All particles, and the energies of the cells summed up."""
    ps, box = water(spark, sf_dir)
    rows = pair_rows(spark, sf_dir, every_type(spark))
    cells = observables.cell_energies(rows.withColumn("e", lj_coulomb(rows).e), binning.binned(ps, box)).agg(r4(F.sum("e")).alias("epot"))
    return arrays.unloaded(ps, ("id",)).agg(F.count("*").alias("n")).join(rows.agg(F.count("*").alias("pairs")), F.lit(True)).join(cells, F.lit(True))


@query(f"{P}, {BIN} SELECT cell, id, x, y, z FROM c WHERE cell % 3 = 0")
def particles_unload_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = binning.binned(*water(spark, sf_dir))
    return arrays.unloaded_cells(cells, cells.where("cell % 3 = 0").select("cell"), ("id", "x", "y", "z"))


@query(f"{P}, {BIN} SELECT cell, id, vx FROM c WHERE id % 7 <> 0 AND cell % 2 = 0")
def particles_stray_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = binning.binned(flagged(spark, sf_dir), fixtures.box(spark, sf_dir))
    return arrays.strays(cells, cells.where("cell % 2 = 0").select("cell"), ("id", "vx"))


@query(f"{fixtures.cte(True, False)} SELECT id, " + ", ".join(f"CASE WHEN id % 7 = 0 THEN {c} ELSE {c} - edge * floor({c} / edge) END AS {c}" for c in "xyz") + " FROM p")
def particles_wrap_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.particles(spark, sf_dir, displaced=True, wrap=False).withColumn("flags", F.when(F.col("id") % 7 == 0, 2).otherwise(0))
    return arrays.wrapped_real(raw, fixtures.box(spark, sf_dir)).select("id", "x", "y", "z")


@query(f"{P} SELECT CASE type WHEN 0 THEN 'OT-0.8476' ELSE 'HT0.4238' END AS name, min(type) AS type, count(*) AS n FROM p GROUP BY 1")
def type_lookup_by_name2(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = fixtures.types(spark)
    named = fixtures.particles(spark, sf_dir).join(types.select("type", F.col("name2").alias("name")), "type").select("id", "name")
    return named.join(forcefield.type_of(types, "name2"), "name").groupBy("name").agg(F.min("type").alias("type"), F.count("*").alias("n"))


@query(f"{BP} SELECT o // 3 AS aid, o AS i, o + 1 AS j, o + 2 AS k FROM v")
def rigid_water_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the angles at oxygens and at first hydrogens, those at oxygens go."""
    at_o = fixtures.angles(fixtures.particles(spark, sf_dir)).drop("pid")
    at_h = at_o.select("aid", F.col("j").alias("i"), F.col("i").alias("j"), "k")
    return forcefield.without_vertex(at_o.union(at_h), named_water(spark, sf_dir), "OT").select("aid", "i", "j", "k")


@query("SELECT o_orderkey AS id, o_orderkey - o_orderkey % 3 AS vid FROM orders")
def water_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forcefield.water_numbered(fixtures.particles(spark, sf_dir), named_water(spark, sf_dir)).select("id", "vid")


@query(f"{PD}, {BONDS.replace('t AS', 'bb AS', 1)}, {ANGLES.replace('t AS', 'aa AS', 1)}, {DIHEDRALS.replace('t AS', 'dd AS', 1)}" + """
SELECT 'atom' AS kind, count(*) AS n, sum(id)::BIGINT AS first, sum(type)::BIGINT AS last, round(sum(q), 4) + 0.0::DOUBLE AS q FROM p UNION ALL SELECT 'bond', count(*), sum(i)::BIGINT, sum(j)::BIGINT, 0 FROM bb
UNION ALL SELECT 'angle', count(*), sum(i)::BIGINT, sum(k)::BIGINT, 0 FROM aa UNION ALL SELECT 'dihedral', count(*), sum(i)::BIGINT, sum(l)::BIGINT, 0 FROM dd""")
def psf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The water written as a PSF and read again."""
    ps = massed(spark, sf_dir).join(fixtures.types(spark).select("type", "name"), "type")
    path = f"{shared_folder(spark)}/lattica-samples/dump-{uuid.uuid4().hex}"
    structure.write_psf(path, ps, fixtures.bonds(ps), fixtures.angles(ps), fixtures.dihedrals(ps, ps.count()))
    top = structure.read_psf(spark, path)
    of = lambda df, kind, a, b, q: df.agg(F.count("*").alias("n"), F.sum(a).cast("long").alias("first"), F.sum(b).cast("long").alias("last"), q.alias("q")).select(F.lit(kind).alias("kind"), "n", "first", "last", "q")
    none = F.first(F.lit(0.0))
    return of(top.atoms, "atom", "id", "type", r4(F.sum("q"))).union(of(top.bonds, "bond", "i", "j", none)).union(of(top.angles, "angle", "i", "k", none)).union(of(top.dihedrals, "dihedral", "i", "l", none))


LJ_OO = "CASE WHEN ti + tj = 0 THEN {} ELSE 0 END"


@query(f"{P}, {PR} SELECT 'none' AS mode, {RND('sum(' + LJ_OO.format(f'{LJ} * {SW}') + ')')} AS e FROM pr UNION ALL SELECT 'shifted', {RND('sum(' + LJ_OO.format(LJ) + f' + {K} * qq * (1 / r - 1 / {N(RC)}))')} FROM pr UNION ALL SELECT 'ewald', {RND('sum(' + LJ_OO.format(f'{LJ} * {SW}') + f' + {EW})')} FROM pr")
def electrostatics_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term that each value of kappa selects, the first and last with a switch, over one set of pairs."""
    rows = pair_rows(spark, sf_dir, every_type(spark))
    terms = [pot.nonbonded(F.col("r2"), F.col("a"), F.col("b"), QQ(), kappa, RC, on) for kappa, on in ((-1.0, ON), (0.0, None), (KAPPA, ON))]
    sums = rows.agg(*[r4(F.sum(t.e)).alias(forcefield.electrostatics(k)) for t, k in zip(terms, (-1.0, 0.0, KAPPA), strict=True)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("e")) for m in sums.columns])).alias("x")).select("x.*")


@query("SELECT * FROM (VALUES ('pair', 0::INT, 1::INT, 1.5::DOUBLE, 2.5::DOUBLE), ('pair', 1, 0, 1.5, 2.5), ('pair', 0, 0, 3.0, 4.0), ('bond', 0, 1, 9.0, 0.1), ('bond', 1, 0, 9.0, 0.1), ('type', 0, 0, 15.9994, -0.8476), ('type', 1, 0, 1.00794, 0.4238), ('exclusion', 0, 1, 0.0, 0.0), ('topology', 1, 1, 1.0, 0.0)) t(kind, i, j, a, b)")
def registered_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species, potentials and topology as the builders give them."""
    field, top = ForceField(), TopologyBuilder()
    o, h = field.add_type("OT", 15.9994, -0.8476), field.add_type("HT", 1.00794, 0.4238)
    field.add_pair(o, h, 1.0, 1.0)
    field.add_pair(h, o, 1.5, 2.5)
    field.add_pair(o, o, 3.0, 4.0)
    field.add_bond(h, o, 9.0, 0.1)
    top.add_bond(0, 1)
    top.add_angle(1, 0, 2, field.add_angle(5.0, 1.9))
    top.add_dihedral(0, 1, 2, 3, field.add_dihedral(1.0, 3, 0.0))
    top.add_exclusion(1, 0)
    t, u = field.tables(spark), top.tables(spark)
    row = lambda df, kind, i, j, a, b: df.select(F.lit(kind).alias("kind"), F.col(i).cast("int").alias("i"), F.col(j).cast("int").alias("j"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    c, zero = F.col, F.lit(0.0)
    counts = u["bonds"].select(F.lit(1).alias("one")).groupBy("one").count().join(u["angles"].agg(F.count("*").alias("m")), F.lit(True)).join(u["dihedrals"].agg(F.count("*").alias("k")), F.lit(True))
    return row(t["pair_pot"], "pair", "type_i", "type_j", c("a"), c("b")).union(row(t["bond_pot"], "bond", "type_i", "type_j", c("k"), c("r0"))).union(row(t["types"].withColumn("zero", F.lit(0)), "type", "type", "zero", c("mass"), c("charge"))).union(row(u["exclusions"], "exclusion", "i", "j", zero, zero)).union(row(counts, "topology", "count", "m", c("k"), zero))


SPEED, V_SEED = 0.7, 11


def drawn_sql(step: int) -> str:
    """The uniform number of a particle."""
    p, o, f = integrate.PRIME, integrate.OTHER, integrate.FACTORS
    a = f"((id % {p} * {f[0]} + id % {p} * {f[1]} + {(V_SEED * 1000003 + step) % p * f[2]}) % {p})"
    b = f"(({a} * {a}) % {o})"
    c = f"(({b} * {f[3]} + id % {p} * {f[4]} + id % {p}) % {p})"
    return f"(((({c} * {c}) % {o} * {f[5]} + {b}) % {p} + 0.5::DOUBLE) / {p}::DOUBLE)"


@query(f"""n AS (SELECT count(*) AS atoms FROM orders), g AS (SELECT min(r) AS nx FROM n, range(1, 2000) AS t(r) WHERE r * r * r >= atoms), l AS (SELECT r AS id, nx FROM n, g, range(0, 10000000) t(r) WHERE r < atoms),
p AS (SELECT id, (id // (nx * nx) + 0.5::DOUBLE) * (3::DOUBLE / nx) AS x, ((id // nx) % nx + 0.5::DOUBLE) * (3::DOUBLE / nx) AS y, (id % nx + 0.5::DOUBLE) * (3::DOUBLE / nx) AS z, 2 * {drawn_sql(1)} - 1 AS up, 2 * pi() * {drawn_sql(2)} AS turn FROM l),
v AS (SELECT *, {SPEED}::DOUBLE * sqrt(1 - up * up) * cos(turn) AS vx, {SPEED}::DOUBLE * sqrt(1 - up * up) * sin(turn) AS vy, {SPEED}::DOUBLE * up AS vz FROM p), c AS (SELECT avg(vx) AS ax, avg(vy) AS ay, avg(vz) AS az FROM v)
SELECT id, {RND("x")} AS x, {RND("y")} AS y, {RND("z")} AS z, {RND("vx - ax")} AS vx, {RND("vy - ay")} AS vy, {RND("vz - az")} AS vz FROM v, c""")
def lattice_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many particles as orders on a cubic lattice, with random velocities of one speed and no drift."""
    box = Box((0.0,) * 3, (3.0,) * 3, 0.7)
    ps = fixtures.lattice(spark, fixtures.orders(spark, sf_dir).count(), box, 39.948, SPEED, V_SEED)
    return ps.select("id", *[r4(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])


@query(f"{ALL}, e AS (SELECT 'bond' AS term, count(*) AS n, sum(188280::DOUBLE * (r0 - 0.09572::DOUBLE) * (r0 - 0.09572::DOUBLE)) AS e FROM (SELECT greatest({N(BOND_A)}, least({N(BOND_B)}, r)) AS r0 FROM bt) UNION ALL SELECT 'angle', count(*), sum(230.12::DOUBLE * (theta - 104.52::DOUBLE * pi() / 180) * (theta - 104.52::DOUBLE * pi() / 180)) FROM ang UNION ALL SELECT 'dihedral', count(*), sum(0.8368::DOUBLE * (1 + cos(3 * phi))) FROM dt) SELECT term, n, round(e, 3) AS e FROM e")
def parsed_field_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter file read, assigned to the topology by species and evaluated, each interaction with its own line."""
    p = parameters.read_charmm(spark, sample(spark, "charmm", CHARMM))
    ps, box = water(spark, sf_dir, True)
    named = named_water(spark, sf_dir)
    lengths = forcefield.assigned_bonds(fixtures.bonds(ps), named, p.bonds).select("bid", "i", "j", "force", "r0")
    kinds = p.bonds.join(forcefield.type_of(fixtures.types(spark)).select(F.col("name").alias("t1"), F.col("type").alias("type_i")), "t1").join(forcefield.type_of(fixtures.types(spark)).select(F.col("name").alias("t2"), F.col("type").alias("type_j")), "t2")
    both = kinds.select("type_i", "type_j", F.col("force").alias("k"), "r0").unionByName(kinds.select(F.col("type_j").alias("type_i"), F.col("type_i").alias("type_j"), F.col("force").alias("k"), "r0"))
    bond = bonded.bond_terms(lengths.select("bid", "i", "j"), ps, both.withColumns({"a": F.lit(BOND_A), "b": F.lit(BOND_B)}), box)
    angles = forcefield.assigned_angles(fixtures.angles(ps).drop("pid"), named, p.angles).select("aid", "i", "j", "k", "force", "theta0")
    dihedrals = forcefield.assigned_dihedrals(fixtures.dihedrals(ps, ps.count()), named, p.dihedrals).select("did", "i", "j", "k", "l", "force", "n", "delta")
    found = {"bond": bond, "angle": bonded.angle_terms(angles, ps, box, F.col("force"), F.col("theta0")), "dihedral": bonded.dihedral_terms(dihedrals, ps, box, F.col("force"), F.col("n"), F.col("delta"))}
    rows = [df.agg(F.count("*").alias("n"), F.round(F.sum("e"), 3).alias("e")).select(F.lit(k).alias("term"), "n", "e") for k, df in found.items()]
    return rows[0].union(rows[1]).union(rows[2])


# Runs


def system(spark: SparkSession, sf_dir: str, **more: object) -> ParticleSystem:
    return ParticleSystem(massed(spark, sf_dir), fixtures.box(spark, sf_dir), every_type(spark), lj_coulomb, exclusions(spark, sf_dir), **more)


def flexible(spark: SparkSession, sf_dir: str, **more: object) -> ParticleSystem:
    """The displaced water with bonds, angles and dihedrals."""
    ps = massed(spark, sf_dir, True)
    angles = fixtures.angles(ps).withColumns({"force": F.lit(ANGLE_K), "theta0": F.lit(THETA0)})
    dihedrals = fixtures.dihedrals(ps, ps.count()).withColumns({"force": F.lit(DIH_K), "n": F.lit(DIH_N), "delta": F.lit(0.0)})
    return ParticleSystem(ps, fixtures.box(spark, sf_dir), every_type(spark), lj_coulomb, exclusions(spark, sf_dir), fixtures.bonds(ps), bond_pot(spark), angles, dihedrals, **more)


RAW = lambda rows, parts: " UNION ALL ".join(f"SELECT {e} AS id, {g.format(c='x')} AS fx, {g.format(c='y')} AS fy, {g.format(c='z')} AS fz FROM {rows}" for e, g in parts.items())
F_BOND = f"(2 * {N(BOND_K)} * (r - {N(BOND_R0)}) / r)"
ALL_ENDS = " UNION ALL ".join((
    PAIR_ENDS(F_SQL, "mi <> mj"), RAW("bt", {"i": f"-{F_BOND} * d{{c}}", "j": f"{F_BOND} * d{{c}}"}), RAW("ang", {"i": ANGLE_I, "k": ANGLE_K_, "j": f"-({ANGLE_I}) - ({ANGLE_K_})"}),
    RAW("dt", {"i": S_DIH + " * " + DIH_I, "l": S_DIH + " * " + DIH_L, "j": f"{S_DIH} * ({DIH_MID} - {DIH_I})", "k": f"-{S_DIH} * ({DIH_MID} + {DIH_L})"}),
))


@query(f"{ALL}, fs AS ({SUMS(ALL_ENDS)}), v1 AS (SELECT id, p.edge, x, y, z, " + ", ".join(f"v{c} + {N(DT)} * coalesce(f{c}, 0) / m AS v{c}" for c in "xyz") + " FROM p LEFT JOIN fs USING (id)), x1 AS (SELECT id, vx, vy, vz, edge, " + ", ".join(f"{c} + {N(DT)} * v{c} AS {c}" for c in "xyz") + " FROM v1) SELECT id, " + ", ".join(f"round({c} - edge * floor({c} / edge), 3) + 0.0::DOUBLE AS {c}, round(v{c}, 3) + 0.0::DOUBLE AS v{c}" for c in "xyz") + " FROM x1")
def full_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step under pairs, bonds, angles and dihedrals."""
    return flexible(spark, sf_dir).step(DT).particles.select("id", *[(F.round(c, 3) + 0.0).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])


@query(f"{ALL} SELECT {RND(f'(SELECT sum({EX_E}) FROM pr WHERE mi <> mj)')} AS nonbond, {RND(f'(SELECT sum({E_BOND}) FROM bt)')} AS bond, {RND(f'(SELECT sum({E_ANGLE}) FROM ang)')} AS angle, {RND(f'(SELECT sum({E_DIH}) FROM dt)')} AS dihedral, {RND(EK)} AS ekin FROM p")
def state_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run reports of a state, by class."""
    return flexible(spark, sf_dir).stats(0).select(*[r4(c).alias(c) for c in (*CLASSES, "ekin")])


@query()
def trajectory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps of the rigid water: constraints, thermostat, and a list of pairs kept while it lasts."""
    edges = rigid_edges(spark, sf_dir).select(F.floor(F.col("i") / 3).alias("rid"), "i", "j", "d2")
    _, rows = system(spark, sf_dir, constraints=settled(edges, "constraints"), heat=(300.0, 0.1), skin=SKIN, kernel=lj_coulomb).trajectory(5, DT)
    return rows.select("step", *[F.round(c, 3).alias(c) for c in ("epot", "ekin", "temperature")])


@query("SELECT s AS step, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders, (VALUES (1), (2)) v(s) GROUP BY s")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of a run that were put away, read again."""
    folder = f"{shared_folder(spark)}/lattica-snapshots-{uuid.uuid4().hex}"
    system(spark, sf_dir).trajectory(2, DT, every=1, folder=folder)
    return spark.read.parquet(folder).groupBy(F.col("step").cast("int").alias("step")).agg(F.count("*").alias("n"), F.sum("id").cast("long").alias("ids"))
