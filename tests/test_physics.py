"""Invariants: forces are minus the gradient, momentum is kept, pairs are those of brute force, tables meet their tolerance."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import potentials as pot
from lattica.functions import tables
from lattica.operators import binning, bonded, bricks, constraints, forcefield, integrate, longrange, observables, pairs
from lattica.plans.system import ParticleSystem, SkinList
from lattica.schema import COULOMB, Box

COLS = "id long, vid long, type int, flags int, q double, x double, y double, z double, vx double, vy double, vz double, m double"


def gas(spark, n=150, edge=3.0, seed=1):
    rng = random.Random(seed)
    rows = [(i, i // 3, i % 2, 0, 0.5 if i % 2 else -0.5, *[rng.random() * edge for _ in range(3)], *[rng.uniform(-1, 1) for _ in range(3)], 1.0 + i % 3) for i in range(n)]
    return spark.createDataFrame(rows, COLS)


@pytest.mark.parametrize("cutoff,edge", [(0.7, None), (0.9, None), (0.7, 0.4)])
def test_pairs_are_those_of_brute_force(spark, cutoff, edge):
    ps, box = gas(spark), Box((0.0,) * 3, (3.0,) * 3, cutoff, edge=edge)
    a = {(r.i, r.j) for r in pairs.neighbour_pairs(ps, box).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).collect()}
    rows = pairs.neighbour_pairs(ps, box).count()
    b = {(r.i, r.j) for r in pairs.all_pairs(ps, box).select("i", "j").collect()}
    assert a == b and rows == len(b) > 100


def test_pairs_without_period(spark):
    ps, box = gas(spark), Box((0.0,) * 3, (3.0,) * 3, 0.7, (False, True, False))
    a = {(min(r.i, r.j), max(r.i, r.j)) for r in pairs.neighbour_pairs(ps, box).collect()}
    assert a == {(r.i, r.j) for r in pairs.all_pairs(ps, box).collect()}


def test_box_needs_three_cells():
    with pytest.raises(ValueError):
        Box((0.0,) * 3, (2.0,) * 3, 0.9)


def test_plan_is_an_equi_join(spark):
    ps, box = gas(spark), Box((0.0,) * 3, (3.0,) * 3, 0.7)
    plan = pairs.neighbour_pairs(ps, box)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_translation_leaves_pairs(spark):
    ps, box = gas(spark), Box((0.0,) * 3, (3.0,) * 3, 0.7)
    moved = binning.wrapped(ps.withColumns({c: F.col(c) + s for c, s in (("x", 1.25), ("y", -0.5), ("z", 7.75))}), box)
    key = lambda d: {(min(r.i, r.j), max(r.i, r.j)) for r in pairs.neighbour_pairs(d, box).collect()}
    assert key(ps) == key(moved)


R = [0.31, 0.4, 0.55, 0.68, 0.74]
TERMS = {
    "lj": lambda r2: pot.lj(r2, 2.6e-6, 2.6e-3),
    "coulomb": lambda r2: pot.coulomb(r2, F.lit(0.3)),
    "shifted": lambda r2: pot.coulomb_shifted(r2, F.lit(0.3), 0.75),
    "ewald": lambda r2: pot.ewald(r2, F.lit(0.3), 3.0),
    "switched": lambda r2: pot.lj_switched(r2, 2.6e-6, 2.6e-3, 0.6, 0.75),
    "sum": lambda r2: pot.lj(r2, 2.6e-6, 2.6e-3) + pot.ewald(r2, F.lit(0.3), 3.0),
}


@pytest.mark.parametrize("name", sorted(TERMS))
def test_force_factor_is_the_slope(spark, name):
    h = 1e-6
    df = spark.createDataFrame([(r, r - h, r + h) for r in R], "r double, lo double, hi double")
    e = lambda c: TERMS[name](F.col(c) * F.col(c)).e
    for row in df.select("r", TERMS[name](F.col("r") * F.col("r")).f.alias("f"), ((e("hi") - e("lo")) / (2 * h) / F.col("r")).alias("g")).collect():
        assert row.f == pytest.approx(row.g, rel=3e-4, abs=2e-3)


def test_erfc(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(0, 40)], "x double")
    for r in df.select("x", pot.erfc(F.col("x")).alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), abs=2e-7)


def test_chebyshev(spark):
    df = spark.createDataFrame([(p,) for p in (0.3, 1.1, 2.4)], "p double")
    for n in range(7):
        for r in df.select("p", pot.chebyshev(n, F.cos("p"))[0].alias("t")).collect():
            assert r.t == pytest.approx(math.cos(n * r.p), abs=1e-9)
    for delta in (0.0, math.pi, 0.7):
        for r in df.select("p", pot.dihedral_energy(F.cos("p"), 2.0, 3, delta)[0].alias("e")).collect():
            assert r.e == pytest.approx(2 * (1 + math.cos(3 * r.p - delta)), abs=1e-9)


def chain(spark, seed=5):
    rng = random.Random(seed)
    rows = [(i, 0, 0, 0, 0.0, 0.3 * i + rng.uniform(-0.1, 0.1), rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3), 0.0, 0.0, 0.0, 1.0) for i in range(4)]
    return rows


def moved(rows, i, axis, h):
    out = [list(r) for r in rows]
    out[i][5 + axis] += h
    return [tuple(r) for r in out]


@pytest.mark.parametrize("kind", ["bond", "angle", "dihedral"])
def test_bonded_forces_are_minus_the_gradient(spark, kind):
    box = Box((-5.0,) * 3, (10.0,) * 3, 1.0)
    top = {"bond": ("bid long, i long, j long", [(0, 0, 1)]), "angle": ("aid long, i long, j long, k long", [(0, 0, 1, 2)]), "dihedral": ("did long, i long, j long, k long, l long", [(0, 0, 1, 2, 3)])}[kind]
    topology = spark.createDataFrame(top[1], top[0])
    bond_pot = spark.createDataFrame([(0, 0, 100.0, 0.25, 0.01, 2.0)], "type_i int, type_j int, k double, r0 double, a double, b double")

    def terms(rows):
        ps = spark.createDataFrame(rows, COLS)
        if kind == "bond":
            return bonded.bond_terms(topology, ps, bond_pot, box), bonded.bond_forces
        if kind == "angle":
            return bonded.angle_terms(topology, ps, box, 10.0, 1.9), bonded.angle_forces
        return bonded.dihedral_terms(topology, ps, box, 2.0, 3, 0.4), bonded.dihedral_forces

    rows = chain(spark)
    t, forces = terms(rows)
    found = {r.id: (r.fx, r.fy, r.fz) for r in forces(t).collect()}
    assert np.allclose(np.sum(list(found.values()), axis=0), 0, atol=1e-9)
    h = 1e-5
    for i, axis in ((0, 0), (1, 1), (max(found), 2)):
        up, down = (terms(moved(rows, i, axis, s))[0].agg(F.sum("e")).first()[0] for s in (h, -h))
        assert found[i][axis] == pytest.approx(-(up - down) / (2 * h), rel=1e-4, abs=1e-5)


def test_ghosts_and_missing_ends(spark):
    box = Box((-5.0,) * 3, (10.0,) * 3, 1.0)
    rows = [list(r) for r in chain(spark)]
    rows[0][3] = rows[1][3] = rows[2][3] = 2
    ps = spark.createDataFrame([tuple(r) for r in rows], COLS)
    bonds = spark.createDataFrame([(0, 0, 1), (1, 2, 3), (2, 3, 99)], "bid long, i long, j long")
    assert [r.bid for r in bonded.placed(bonds, ps, "ij").collect()] == [1]


def lj(rows):
    return pot.lj(F.col("r2"), F.col("a"), F.col("b"))


def small_system(spark, n=64):
    side = 4
    rng = random.Random(2)
    at = [(i // 16, i // 4 % side, i % side) for i in range(n)]
    rows = [(i, i, 0, 0, 0.0, *[0.4 * c + 0.2 + rng.uniform(-0.02, 0.02) for c in p], *[rng.uniform(-0.2, 0.2) for _ in range(3)], 2.0) for i, p in enumerate(at)]
    box = Box((0.0,) * 3, (1.6,) * 3, 0.5)
    pair_pot = spark.createDataFrame([(0, 0, 2.6e-6, 2.6e-3)], "type_i int, type_j int, a double, b double")
    return ParticleSystem(spark.createDataFrame(rows, COLS), box, pair_pot, lj)


def test_steps_keep_momentum(spark):
    s = small_system(spark)
    f = s.forces().agg(*[F.sum(c) for c in ("fx", "fy", "fz")]).first()
    assert np.allclose(f, 0, atol=1e-9)
    after, rows = s.trajectory(2, 0.001)
    momentum = lambda ps: np.array(ps.agg(*[F.sum(F.col("m") * F.col(v)) for v in ("vx", "vy", "vz")]).first())
    assert np.allclose(momentum(s.particles), momentum(after.particles), atol=1e-9)
    assert [r.step for r in rows.orderBy("step").collect()] == [1, 2]


def test_skin_list(spark):
    s = small_system(spark)
    kept = SkinList.made(s.particles, Box((0.0,) * 3, (1.6,) * 3, 0.4), 0.1)
    later = s.particles.withColumn("x", F.col("x") + 0.01 * F.col("id") / 64)
    assert not kept.stale(later)
    a = {(min(r.i, r.j), max(r.i, r.j)) for r in kept.pairs(later).collect()}
    assert a == {(r.i, r.j) for r in pairs.all_pairs(later, kept.box).collect()}
    assert kept.stale(s.particles.withColumn("x", F.col("x") + 0.2 * F.col("id") / 64))


def test_thermostat_reaches_its_target(spark):
    rows = gas(spark)
    t = observables.temperature(rows)
    after = observables.temperature(integrate.thermostat(rows, t, 300.0, 1.0).drop("w")).first()["temperature"]
    assert after == pytest.approx(300.0)
    fastest = integrate.capped(rows, 0.5).agg(F.max(observables.square("vx", "vy", "vz"))).first()[0]
    assert fastest == pytest.approx(0.25)


def test_dpd_noise_is_symmetric_and_normal(spark):
    df = spark.range(200).select(F.col("id").alias("i"), (F.col("id") * 3 + 1).alias("j"))
    a = df.select(integrate.uniform(F.col("i"), F.col("j"), 7).alias("a"), integrate.uniform(F.col("j"), F.col("i"), 7).alias("b")).toPandas()
    assert (a["a"] == a["b"]).all() and a["a"].between(0, 1).all() and a["a"].nunique() > 190
    z = integrate.with_normal(spark.createDataFrame([(0.5,), (0.975,), (0.1,)], "u double"), F.col("u"), "z").toPandas()["z"]
    assert np.allclose(z, [0.0, 1.95996, -1.28155], atol=1e-3)


@pytest.mark.parametrize("tol", [1e-3, 1e-7])
def test_table_is_within_tolerance(tol):
    f = lambda r: 2.6e-6 / r**12 - 2.6e-3 / r**6
    t = tables.fitted(f, 0.25, 1.0, tol)
    r = np.linspace(0.25, 1.0, 5001)
    assert np.max(np.abs(t.value(r)[0] - f(r)) / np.maximum(np.abs(f(r)), 1)) <= 2 * tol
    with pytest.raises(ValueError):
        tables.fitted(lambda r: np.sin(1e6 * r), 0.25, 1.0, 1e-9)


def test_table_in_a_plan(spark):
    t = tables.fitted(lambda r: np.array([math.erfc(3 * x) / x for x in np.ravel(r)]).reshape(np.shape(r)), 0.2, 1.0, 1e-6)
    rows = [(float(r),) for r in np.linspace(0.2, 1.0, 97)]
    got = tables.evaluated(spark.createDataFrame(rows, "r double").withColumn("r2", F.col("r") * F.col("r")), t).toPandas()
    e, d = t.value(got["r"].to_numpy())
    assert np.allclose(got["e"], e, rtol=1e-9) and np.allclose(got["f"], d / got["r"], rtol=1e-7)
    assert tables.frame(spark, {3: t}).count() == len(t.coeffs)


def test_shake_meets_its_constraints(spark):
    box = Box((0.0,) * 3, (3.0,) * 3, 0.7)
    old = {0: (1.0, 1.0, 2.99), 1: (1.1, 1.0, 2.99), 2: (1.0, 1.1, 0.02)}
    rows = [(7, i, 1.0 + i, *[u + 0.01 * (i + k) for k, u in enumerate(p)], 0.1, 0.2, 0.3, *p) for i, p in old.items()]
    state = spark.createDataFrame(rows, "rid long, id long, m double, x double, y double, z double, vx double, vy double, vz double, ox double, oy double, oz double")
    near = lambda d: d - 3.0 * np.floor(d / 3.0 + 0.5)
    d2 = lambda i, j: float(np.sum(near(np.array(old[i]) - np.array(old[j])) ** 2))
    rules = spark.createDataFrame([(7, i, j, d2(i, j)) for i, j in ((0, 1), (0, 2), (1, 2))], "rid long, i long, j long, d2 double")
    got = constraints.shake(state, rules, box, 0.002).toPandas().sort_values("id")
    assert (got["residual"] < 1e-7).all()
    x = got[["x", "y", "z"]].to_numpy()
    assert np.sum(near(x[0] - x[2]) ** 2) == pytest.approx(d2(0, 2), abs=1e-7)
    m = np.array([1.0, 2.0, 3.0])
    assert np.allclose(m @ got[["vx", "vy", "vz"]].to_numpy(), m.sum() * np.array([0.1, 0.2, 0.3]), atol=1e-9)


def test_groups_of_a_chain(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (4, 3), (3, 2), (2, 1), (1, 0), (20, 21)], "i long, j long")
    got = {r.id: r.rid for r in constraints.groups(edges).collect()}
    assert got == {**{i: 0 for i in range(10)}, 20: 20, 21: 20}


def test_assignment_rules(spark):
    named = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (3, "D")], "id long, name string")
    dih = spark.createDataFrame([(0, 0, 1, 2, 3)], "did long, i long, j long, k long, l long")
    params = spark.createDataFrame([("D", "C", "X", "A", 4, 1.0), ("X", "B", "C", "X", 2, 2.0), ("A", "B", "C", "D", 9, 3.0)], "t1 string, t2 string, t3 string, t4 string, line int, force double")
    assert forcefield.assigned_dihedrals(dih, named, params).first()["force"] == 2.0
    angles = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3)], "aid long, i long, j long, k long")
    ap = spark.createDataFrame([("A", "B", "C", 1, 1.0), ("C", "B", "A", 5, 2.0)], "t1 string, t2 string, t3 string, line int, force double")
    got = {r.aid: r.force for r in forcefield.assigned_angles(angles, named, ap).collect()}
    assert got == {0: 2.0, 1: None}
    assert [forcefield.electrostatics(k) for k in (-1.0, 0.0, 3.0)] == ["none", "shifted", "ewald"]


def test_mesh_energy_is_that_of_the_direct_sum(spark):
    """Reciprocal part against its definition, for a few charges."""
    edge, kappa, grid = 2.0, 2.0, 32
    rng = random.Random(4)
    parts = [(i, (-1.0) ** i, *[rng.random() * edge for _ in range(3)]) for i in range(8)]
    box = Box((0.0,) * 3, (edge,) * 3, 0.5)
    ps = spark.createDataFrame(parts, "id long, q double, x double, y double, z double")
    got = longrange.energy(longrange.convolved(longrange.spread(ps, box, grid), box, grid, kappa)).first()["e"]
    q, x = np.array([p[1] for p in parts]), np.array([p[2:] for p in parts])
    want = 0.0
    for m in np.ndindex(17, 17, 17):
        k = (np.array(m) - 8) / edge
        k2 = k @ k
        if k2:
            s = (q * np.exp(2j * np.pi * x @ k)).sum()
            want += COULOMB / (2 * np.pi * edge**3) * math.exp(-(np.pi**2) * k2 / kappa**2) / k2 * abs(s) ** 2
    assert got == pytest.approx(want, rel=2e-3)


@pytest.mark.parametrize("edge", [2.5, 6.0])
def test_mesh_follows_the_box(spark, edge):
    """At the query's spacing and kappa, in boxes of several edges, against the direct sum."""
    kappa, box = 3.0, Box((0.0,) * 3, (edge,) * 3, 0.75)
    ps = gas(spark, 60, edge)
    grid = longrange.mesh(box, kappa)
    got = longrange.energy(longrange.convolved(longrange.spread(ps, box, grid), box, grid, kappa)).first()["e"]
    rows = ps.select("q", "x", "y", "z").toPandas().to_numpy()
    top = math.ceil(1.7 * kappa * edge)
    k = np.stack(np.meshgrid(*[np.arange(-top, top + 1) / edge] * 3, indexing="ij"), -1).reshape(-1, 3)
    k2 = (k * k).sum(axis=1)
    k, k2 = k[(k2 > 0) & (k2 < (1.7 * kappa) ** 2)], k2[(k2 > 0) & (k2 < (1.7 * kappa) ** 2)]
    s = sum(q * np.exp(2j * np.pi * (k @ r)) for q, *r in rows)
    assert got == pytest.approx(COULOMB / (2 * np.pi * edge**3) * (np.exp(-(np.pi**2) * k2 / kappa**2) / k2 * abs(s) ** 2).sum(), rel=2e-3)


def test_bad_pdb_record(spark, tmp_path):
    from lattica.sources import structure

    (tmp_path / "a.pdb").write_text("ATOM 1 A W 1 1.0 2.0 3.0\nHELIX 1\nEND\n")
    with pytest.raises(Exception, match="unknown record"):
        structure.read_pdb(spark, f"file://{tmp_path}/a.pdb").collect()


def test_pdb_round_trip(spark, tmp_path):
    from lattica.sources import structure

    ps = spark.createDataFrame([(i, 99990 + i, "OT", i * 0.1, 0.2, -0.3) for i in range(12)], "id long, vid long, name string, x double, y double, z double")
    structure.write_pdb(ps.coalesce(1), f"file://{tmp_path}/out")
    text = "".join(sorted(p.read_text() for p in (tmp_path / "out").glob("part-*"))) + "END\n"
    (tmp_path / "b.pdb").write_text(text)
    got = structure.read_pdb(spark, f"file://{tmp_path}/b.pdb").toPandas()
    assert np.allclose(got["x"], [i * 0.1 for i in range(12)], atol=1e-4)


# Whole steps


def chain_system(spark, **more):
    """A small gas with bonds, angles and dihedrals along its ids."""
    s = small_system(spark, 64)
    ids = range(0, 60, 4)
    bonds = spark.createDataFrame([(i, i, i + 1) for i in ids], "bid long, i long, j long")
    angles = spark.createDataFrame([(i, i, i + 1, i + 2, 20.0 + i, 1.8) for i in ids], "aid long, i long, j long, k long, force double, theta0 double")
    dihedrals = spark.createDataFrame([(i, i, i + 1, i + 2, i + 3, 0.5, i % 7, 0.3 if i % 3 else 0.0) for i in ids], "did long, i long, j long, k long, l long, force double, n int, delta double")
    bond_pot = spark.createDataFrame([(0, 0, 500.0, 0.4, 0.01, 2.0)], "type_i int, type_j int, k double, r0 double, a double, b double")
    return ParticleSystem(s.particles, s.box, s.pair_pot, s.term, None, bonds, bond_pot, angles, dihedrals, **more)


def energy(s):
    row = s.stats(0).first()
    return row.epot, row.ekin


def test_work_is_minus_the_gradient(spark):
    s = chain_system(spark)
    f = {r.id: (r.fx, r.fy, r.fz) for r in s.work().collect()}
    assert np.allclose(np.sum(list(f.values()), axis=0), 0, atol=1e-8)
    h = 1e-5
    for i, axis in ((0, "x"), (9, "y"), (30, "z")):
        at = lambda d, i=i, axis=axis: energy(ParticleSystem(**{**s.__dict__, "particles": s.particles.withColumn(axis, F.col(axis) + F.when(F.col("id") == i, d).otherwise(0.0))}))[0]
        assert f[i]["xyz".index(axis)] == pytest.approx(-(at(h) - at(-h)) / (2 * h), rel=1e-4, abs=1e-4)


def test_whole_steps_keep_energy_and_momentum(spark, tmp_path):
    """Without thermostat, energy (kinetic at the half step, so to first order) and momentum are kept; snapshots are there."""
    s = chain_system(spark, skin=0.03)
    after, rows = s.trajectory(4, 0.0005, every=2, folder=f"file://{tmp_path}/states")
    total = [r.epot + r.ekin for r in rows.orderBy("step").collect()]
    assert max(total) - min(total) < 0.02 * abs(total[0])
    momentum = lambda ps: np.array(ps.agg(*[F.sum(F.col("m") * F.col(v)) for v in ("vx", "vy", "vz")]).first())
    assert np.allclose(momentum(s.particles), momentum(after.particles), atol=1e-8)
    states = spark.read.parquet(f"file://{tmp_path}/states")
    assert {(r.step, r["count"]) for r in states.groupBy("step").count().collect()} == {(2, 64), (4, 64)}
    last = states.where("step = 4").orderBy("id").select("x", "vx").toPandas()
    assert np.allclose(last, after.particles.orderBy("id").select("x", "vx").toPandas())


def test_a_step_makes_one_pair_join(spark):
    """Forces and energies of a state come from one join on cells, and exclusions need no exchange above it."""
    s = chain_system(spark)
    plan = s.work()._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join Inner" in line and "nx#" in line for line in plan.splitlines()) == 1
    gone = spark.createDataFrame([(0, 1), (2, 3)], "i long, j long")
    found = pairs.neighbour_pairs(s.particles, s.box, exclusions=gone)
    tree = found._jdf.queryExecution().sparkPlan().toString()
    above = tree[: tree.index("Join")] if "Join" in tree else tree
    assert "Exchange" not in above and "LeftAnti" not in tree
    a = {(min(r.i, r.j), max(r.i, r.j)) for r in found.collect()}
    assert a == {(r.i, r.j) for r in pairs.all_pairs(s.particles, s.box).collect()} - {(0, 1), (2, 3)}


def test_thermostat_and_noise_in_a_run(spark):
    s = small_system(spark)
    hot, rows = ParticleSystem(**{**s.__dict__, "heat": (50.0, 1.0)}).trajectory(1, 0.0005)
    assert rows.first()["temperature"] == pytest.approx(50.0)
    noisy = ParticleSystem(**{**s.__dict__, "dpd": (25.0, 4.5, 7)})
    one, two = noisy.step(0.0005, number=1), noisy.step(0.0005, number=2)
    p = lambda x: np.array(x.particles.agg(*[F.sum(F.col("m") * F.col(v)) for v in ("vx", "vy", "vz")]).first())
    assert np.allclose(p(one), p(two), atol=1e-8) and one.particles.agg(F.sum(F.abs("vx"))).first() != two.particles.agg(F.sum(F.abs("vx"))).first()


def rigid_molecules(spark, n=40):
    """Bent chains of two to five parts, some with all distances fixed."""
    rng = random.Random(8)
    state, rules, nid = [], [], 0
    for g in range(n):
        size = 2 + g % 4
        at = [np.array([rng.random() * 3 for _ in range(3)])]
        for _ in range(size - 1):
            step = np.array([rng.uniform(-1, 1) for _ in range(3)])
            at.append(at[-1] + 0.12 * step / np.linalg.norm(step))
        links = [(a, a + 1) for a in range(size - 1)] + ([(0, 2)] if size == 3 else [])
        for k, x in enumerate(at):
            new = x + np.array([rng.uniform(-0.004, 0.004) for _ in range(3)])
            state.append((g, nid + k, 1.0 + k, *map(float, new), 0.1, 0.2, 0.3, *map(float, x)))
        rules += [(g, nid + a, nid + b, float(np.sum((at[a] - at[b]) ** 2))) for a, b in links]
        nid += size
    cols = "rid long, id long, m double, x double, y double, z double, vx double, vy double, vz double, ox double, oy double, oz double"
    return spark.createDataFrame(state, cols), spark.createDataFrame(rules, "rid long, i long, j long, d2 double")


def test_both_solvers_agree(spark):
    state, rules = rigid_molecules(spark)
    box = Box((0.0,) * 3, (3.0,) * 3, 0.7)
    a, b = (constraints.shake(state, rules, box, 0.002, tol=1e-12, preconditioned=p).toPandas().sort_values("id") for p in (False, True))
    assert len(a) == state.count() and (a["residual"] < 1e-11).all() and (b["residual"] < 1e-11).all()
    assert np.allclose(a[["x", "y", "z", "vx", "vy", "vz"]], b[["x", "y", "z", "vx", "vy", "vz"]], atol=1e-7)
    assert b["sweeps"].mean() < a["sweeps"].mean()


def test_groups_that_are_too_large(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)], "i long, j long")
    with pytest.raises(ValueError, match="more than 10"):
        constraints.groups(edges)
    with pytest.raises(ValueError, match="more than 10"):
        constraints.groups(spark.createDataFrame([(0, i) for i in range(1, 12)], "i long, j long"))


def test_mesh_forces_are_minus_the_gradient(spark):
    rng = random.Random(4)
    parts = [(i, (-1.0) ** i, *[rng.random() * 2 for _ in range(3)]) for i in range(8)]
    box, grid, kappa = Box((0.0,) * 3, (2.0,) * 3, 0.5), 32, 2.0

    def phi(rows):
        ps = spark.createDataFrame(rows, "id long, q double, x double, y double, z double")
        return ps, longrange.convolved(longrange.spread(ps, box, grid), box, grid, kappa)

    f = {r.id: (r.fx, r.fy, r.fz) for r in longrange.forces(*phi(parts), box, grid).collect()}
    h = 1e-4
    for i, axis in ((0, 0), (3, 1), (6, 2)):
        up, down = (longrange.energy(phi([tuple(v + (d if k == i and n == 2 + axis else 0) for n, v in enumerate(p)) for k, p in enumerate(parts)])[1]).first()["e"] for d in (h, -h))
        assert f[i][axis] == pytest.approx(-(up - down) / (2 * h), rel=1e-4, abs=1e-6)


def test_mesh_by_slabs(spark):
    """Energy and forces from slabs are those of the grid in rows, also on an odd grid, where most planes are empty and where
    charges or places are missing; the rows are held to one transform of the whole grid."""
    rng, grid = random.Random(6), 45
    box, kappa = Box((-0.5, 0.25, 1.0), (2.0, 2.5, 3.0), 0.5), 2.0
    parts = [(i, (-1.0) ** i, *[o + rng.random() * d * (0.1 if i < 6 else 1.2) for o, d in zip(box.origin, box.dim, strict=True)]) for i in range(9)]
    parts += [(9, None, 0.0, 1.0, 2.0), (10, 1.0, None, 1.0, 2.0)]
    for rows in (parts, parts[:6]):
        ps = spark.createDataFrame(rows, "id long, q double, x double, y double, z double")
        phi = longrange.convolved(longrange.spread(ps.dropna(), box, grid), box, grid, kappa)
        planes = longrange.transformed(ps, box, grid)
        e, want = (x.first()["e"] for x in (longrange.mesh_energy(planes, box, grid, kappa), longrange.energy(phi)))
        assert (e is None and want is None) or e == pytest.approx(want, rel=1e-9, abs=1e-12)
        want = {r.id: (r.fx, r.fy, r.fz) for r in longrange.forces(ps.dropna(), phi, box, grid).collect()}
        got = {r.id: (r.fx, r.fy, r.fz) for r in longrange.mesh_forces(ps, longrange.potential(planes, box, grid, kappa), box, grid).collect()}
        assert set(got) == {r[0] for r in rows if r[2] is not None} and got.pop(9, None) in (None, (None,) * 3)
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-8, abs=1e-11) for i in got)
        if rows is parts:
            q = np.zeros((grid,) * 3)
            for r in phi.collect():
                q[r.gx, r.gy, r.gz] = r.q
            whole = np.fft.irfftn(np.fft.rfftn(q) * longrange.influence(box, grid, kappa), q.shape, (0, 1, 2)) * (q.size * COULOMB / (math.pi * math.prod(box.dim)))
            assert phi.count() == grid**3 and all(r.phi == pytest.approx(whole[r.gx, r.gy, r.gz], rel=1e-8, abs=1e-11) for r in phi.collect())


def test_mesh_queries_need_no_task_with_the_grid(spark):
    from lattica.plans import queries

    plan = lambda q: queries.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" not in plan("spme_energy")
    assert "Join" not in plan("spme_forces")


def test_splines(spark):
    u = np.linspace(0.05, 3.95, 40)
    df = spark.createDataFrame([(float(x),) for x in u], "u double").select(longrange.spline(F.col("u")).alias("w"), longrange.slope(F.col("u")).alias("d")).toPandas()
    assert np.allclose(df["w"], longrange.cardinal(u, 4))
    assert np.allclose(df["d"], longrange.cardinal(u, 3) - longrange.cardinal(u - 1, 3))


def test_inverse_normal(spark):
    from statistics import NormalDist

    u = [1e-9, 1e-4, 0.02, 0.0243, 0.1, 0.5, 0.7, 0.9757, 0.99999]
    got = integrate.with_normal(spark.createDataFrame([(x,) for x in u], "u double").coalesce(1), F.col("u"), "z").toPandas()["z"]
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in u], rtol=2e-9, atol=1e-9)


def test_noise_differs_by_step_and_pair(spark):
    df = spark.range(300).select(F.col("id").alias("i"), (F.col("id") * 7 + 1).alias("j"))
    a, b = (df.select(integrate.uniform(F.col("i"), F.col("j"), 7, s).alias("u")).toPandas()["u"] for s in (1, 2))
    assert a.nunique() == b.nunique() == 300 and not set(a) & set(b) and abs(a.mean() - 0.5) < 0.06 and abs(np.corrcoef(a, b)[0, 1]) < 0.2


def test_ids_by_place_and_running_sums(spark):
    from lattica.operators.state import running
    from lattica.sources import arrays

    rng = random.Random(3)
    rows = [(rng.random(), rng.random(), rng.random(), 0) for _ in range(500)]
    got = arrays.loaded(spark.createDataFrame(rows, "x double, y double, z double, type int").repartition(7)).orderBy("id").collect()
    assert [(r.id, r.x) for r in got] == [(i, x) for i, (x, *_) in enumerate(sorted(rows))]
    sums = running(spark.createDataFrame([(i, i % 5) for i in range(200)], "k long, v long").repartition(5), "before", "k", of=F.col("v")).orderBy("k").collect()
    assert [r.before for r in sums] == [sum(i % 5 for i in range(k)) for k in range(200)]


def test_registry_checks():
    from lattica.plans.registry import ForceField, TopologyBuilder

    f, t = ForceField(), TopologyBuilder()
    f.add_type("A", 1.0)
    for bad in (lambda: f.add_type("A", 2.0), lambda: f.add_pair(0, 1, 1.0, 1.0), lambda: t.add_bond(1, 1), lambda: t.add_angle(0, 1, 0), lambda: t.add_exclusion(-1, 2)):
        with pytest.raises(ValueError):
            bad()


def test_topology_appended(spark):
    from lattica.plans.registry import more

    table = spark.createDataFrame([(0, 5, 6), (1, 7, 8)], "bid long, i long, j long")
    got = more(table, spark.createDataFrame([(3, 4), (1, 2)], "i long, j long"), "bid").orderBy("bid").collect()
    assert [tuple(r) for r in got] == [(0, 5, 6), (1, 7, 8), (2, 1, 2), (3, 3, 4)]
    assert [r.bid for r in more(table.limit(0), spark.createDataFrame([(3, 4)], "i long, j long"), "bid").collect()] == [0]


def test_token_predicates(spark):
    from lattica.sources import text

    df = spark.createDataFrame([(c,) for c in (" ", "\t", "a", "!", "{", "\n")], "c string")
    got = df.select(text.is_space(F.col("c")).alias("s"), text.starts_comment(F.col("c"), "!{").alias("b"), text.stops_comment(F.col("c")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (True, False, False), (False, False, False), (False, True, False), (False, True, False), (True, False, True)]


def test_psf_numbers_broken_into_lines(spark, tmp_path):
    """Several rows to a line and rows across lines are read alike; excluded species are not written."""
    from lattica.sources import structure

    text = "PSF\n\n 4 !NATOM\n" + "".join(f" {k} W 1 WAT A{k} {'OT' if k % 2 else 'HT'} {0.5 * k} 1.0 0\n" for k in range(1, 5)) + "\n 3 !NBOND: bonds\n 1 2 1\n 3\n 2 4\n\n 1 !NTHETA: angles\n 2 1 3\n"
    (tmp_path / "a.psf").write_text(text)
    top = structure.read_psf(spark, f"file://{tmp_path}/a.psf")
    assert [(r.bid, r.i, r.j) for r in top.bonds.orderBy("bid").collect()] == [(0, 0, 1), (1, 0, 2), (2, 1, 3)]
    assert [(r.i, r.j, r.k) for r in top.angles.collect()] == [(1, 0, 2)] and top.dihedrals.count() == 0 and top.types.count() == 4
    lines = structure.psf_lines(top.atoms, top.bonds, top.angles, top.dihedrals, ("HT",)).where("line like '%!%'").collect()
    assert {r.line.split("!")[1].split(":")[0]: int(r.line.split()[0]) for r in lines} == {"NATOM": 2, "NBOND": 1, "NTHETA": 0, "NPHI": 0, "NIMPHI": 0}


# Pairs kept by bricks of the box


def brute(ps, box, gone=()):
    return {(r.i, r.j) for r in pairs.all_pairs(ps, box).collect()} - set(gone)


@pytest.mark.parametrize("held,edge,periodic", [(10_000, (3.0,) * 3, (True,) * 3), (12, (3.0,) * 3, (True,) * 3), (12, (3.0, 2.0, 4.5), (True, False, True)), (3, (3.0, 2.0, 4.5), (False, True, False))])
def test_bricks_lose_no_pair(spark, monkeypatch, held, edge, periodic):
    """One brick, where copies are images of its own particles, two along an axis and more; a state in which particles have
    gone on, some past the end of the box; exclusions between bricks as well."""
    monkeypatch.setattr(bricks, "HELD", held)
    rng = random.Random(5)
    rows = [(i, i // 3, i % 2, 0, 0.5 if i % 2 else -0.5, *[rng.random() * e for e in edge], 0.0, 0.0, 0.0, 1.0) for i in range(180)]
    ps, box = spark.createDataFrame(rows, COLS), Box((0.0,) * 3, edge, 0.6, periodic)
    near = sorted(brute(ps, box))
    gone = near[::3]
    # the same pair again, and the other way round
    kept = SkinList.made(ps, box, 0.1, spark.createDataFrame([*gone, gone[0], gone[1][::-1]], "i long, j long"))
    later = binning.wrapped(ps.withColumns({c: F.col(c) + 0.03 * F.sin(F.col("id") * k) for c, k in zip("xyz", (1, 2, 3), strict=True)}), box)
    assert not kept.stale(later)
    for now in (ps, later):
        found = [(min(r.i, r.j), max(r.i, r.j)) for r in kept.pairs(now).collect()]
        assert len(found) == len(set(found)) and set(found) == brute(now, box, gone) and len(found) > 100
    got, want = ({(min(r.i, r.j), max(r.i, r.j)): r for r in d.collect()} for d in (kept.pairs(later), pairs.neighbour_pairs(later, box)))
    for k, r in got.items():
        s = 1 if (r.i, r.j) == (want[k].i, want[k].j) else -1
        assert np.allclose((r.dx, r.dy, r.dz), (s * want[k].dx, s * want[k].dy, s * want[k].dz), atol=1e-12)
        assert {(r.i, r.type_i, r.q_i), (r.j, r.type_j, r.q_j)} == {(n, n % 2, 0.5 if n % 2 else -0.5) for n in k}


def test_forces_summed_in_bricks(spark, monkeypatch):
    """They are those of the joined pairs, also where types have no potential."""
    monkeypatch.setattr(bricks, "HELD", 12)
    term = lambda rows: pot.coulomb(*((F.col("r2"), F.col("q_i") * F.col("q_j")) if not isinstance(rows, dict) else (rows["r2"], rows["q_i"] * rows["q_j"]))) + pot.lj(*[F.col(c) if not isinstance(rows, dict) else rows[c] for c in ("r2", "a", "b")])
    pair_pot = spark.createDataFrame([(0, 0, 2.6e-6, 2.6e-3), (0, 1, 1e-6, 1e-3), (1, 0, 1e-6, 1e-3)], "type_i int, type_j int, a double, b double")
    s = ParticleSystem(gas(spark), Box((0.0,) * 3, (3.0,) * 3, 0.7), pair_pot, term, skin=0.1)
    want = s.work().orderBy("id").toPandas()
    got = ParticleSystem(**{**s.__dict__, "kernel": term}).settled().work().orderBy("id").toPandas()
    assert got["id"].tolist() == want["id"].tolist()
    assert np.allclose(got[["fx", "fy", "fz"]], want[["fx", "fy", "fz"]], rtol=1e-9, atol=1e-9)
    assert got["nonbond"].sum() == pytest.approx(want["nonbond"].sum())


def test_a_run_keeps_little_on_disk(spark, monkeypatch):
    """A kept pair takes less than two bytes; a run leaves its last state and its rows of stats, not its other tables, and
    steps as it does without a list."""
    import pathlib

    from lattica.operators.state import shared_folder
    from lattica.plans import queries as q
    from tests.helpers import SF

    shared = pathlib.Path(shared_folder(spark).removeprefix("file://"))
    size = lambda at: sum(p.stat().st_size for p in at.rglob("*.parquet"))
    ps, box = q.massed(spark, SF), q.fixtures.box(spark, SF)
    before = set(shared.iterdir())
    kept = SkinList.made(ps, box, q.SKIN)
    (folder,) = set(shared.iterdir()) - before
    assert size(folder) < 2 * kept.pairs(ps).count()
    edges = q.settled(q.rigid_edges(spark, SF).select(F.floor(F.col("i") / 3).alias("rid"), "i", "j", "d2"))
    make = lambda **more: q.system(spark, SF, constraints=edges, heat=(300.0, 0.1), **more)
    before = set(shared.iterdir())
    _, rows = make(skin=q.SKIN, kernel=q.lj_coulomb).trajectory(2, q.DT)
    assert sorted(p.name.split("-")[0] for p in set(shared.iterdir()) - before) == ["state", "stats", "stats"]
    _, plain = make().trajectory(2, q.DT)
    a, b = (d.orderBy("step").select("epot", "ekin", "temperature").toPandas() for d in (rows, plain))
    assert np.allclose(a, b, rtol=1e-9)


def test_trajectory_stats_goes_all_five_steps(spark):
    """Each of its rows is that of a run by all pairs, without lists, bricks or tables, and constraints solved by more sweeps."""
    from lattica.plans import queries as q
    from lattica.schema import COULOMB, GAS
    from tests.helpers import SF

    got = q.trajectory_stats(spark, SF).orderBy("step").toPandas()
    assert got["step"].tolist() == [1, 2, 3, 4, 5]
    ps, box = q.massed(spark, SF).orderBy("id").toPandas(), q.fixtures.box(spark, SF)
    x, v, m, edge = ps[["x", "y", "z"]].to_numpy(), ps[["vx", "vy", "vz"]].to_numpy(), ps["m"].to_numpy()[:, None], box.dim[0]
    near = lambda d: d - edge * np.floor(d / edge + 0.5)
    i, j = np.triu_indices(len(ps), 1)
    i, j = (k[ps["vid"].to_numpy()[i] != ps["vid"].to_numpy()[j]] for k in (i, j))
    kind, qq = ps["type"].to_numpy(), ps["q"].to_numpy()
    rigid = [(np.arange(a, len(ps), 3), np.arange(b, len(ps), 3)) for a, b in ((0, 1), (0, 2), (1, 2))]
    kept = [(near(x[a] - x[b]) ** 2).sum(axis=1) for a, b in rigid]

    def work(x):
        d = near(x[i] - x[j])
        r2 = (d * d).sum(axis=1)
        at = np.flatnonzero(r2 <= box.cutoff**2)
        r2, a, b, oxygen = r2[at], i[at], j[at], (kind[i[at]] + kind[j[at]] == 0)
        lj, c = np.where(oxygen, q.A / r2**6 - q.B / r2**3, 0.0), COULOMB * qq[a] * qq[b] / np.sqrt(r2)
        f = (np.where(oxygen, -12 * q.A / r2**6 + 6 * q.B / r2**3, 0.0) - c)[:, None] / r2[:, None] * d[at]
        out = np.zeros_like(x)
        np.add.at(out, a, -f)
        np.add.at(out, b, f)
        return (lj + c).sum(), out

    _, f = work(x)
    for row in got.itertuples():
        old, v = x, v + q.DT * f / m
        x = x + q.DT * v
        free = x.copy()
        for _ in range(100):
            for (a, b), d2 in zip(rigid, kept, strict=True):
                d, o = near(x[a] - x[b]), near(old[a] - old[b])
                s = ((d * d).sum(axis=1) - d2)[:, None] / (2 * (d * o).sum(axis=1)[:, None] * (1 / m[a] + 1 / m[b]))
                x[a] -= s / m[a] * o
                x[b] += s / m[b] * o
        v = v + (x - free) / q.DT
        x = x - edge * np.floor(x / edge)
        free_degrees = 3 * len(ps) - sum(len(d) for d in kept)
        heat = lambda: (0.5 * m * v * v).sum()  # noqa: B023, E731
        v = v * np.sqrt(1 + 0.1 * (300.0 / (2 * heat() / (GAS * free_degrees)) - 1))
        epot, f = work(x)
        assert (row.epot, row.ekin, row.temperature) == pytest.approx((epot, heat(), 2 * heat() / (GAS * free_degrees)), rel=1e-5)


def test_a_loops_shuffles_grow_with_its_rows(spark, monkeypatch):
    """However few partitions the session asks for, a task of a long table's loop gets few rows; the setting stays as it was."""
    from lattica.operators import state

    monkeypatch.setattr(state, "ROWS", 100)
    was = {k: spark.conf.get(k) for k in (state.PARTITIONS, "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = {n: state.Held(n)(spark.range(2000).repartition("id"), "rows").groupBy(F.input_file_name()).count().collect() for n in (0, 2000)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was["spark.sql.adaptive.enabled"])
    assert len(held[0]) == int(was[state.PARTITIONS]) and len(held[2000]) == 20 and sum(r["count"] for r in held[2000]) == 2000
    assert spark.conf.get(state.PARTITIONS) == was[state.PARTITIONS]
