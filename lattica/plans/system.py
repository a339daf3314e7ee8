"""A particle system: tables, box and force field, with lazy pairs, forces and steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.potentials import Term
from lattica.operators import bonded, bricks, observables
from lattica.operators.binning import wrapped
from lattica.operators.integrate import FORCES, constrained, dpd_pairs, members, moved, projected, solved, thermostat
from lattica.operators.pairs import PAIR, neighbour_pairs, with_potential
from lattica.operators.state import SMALL, Held, settled
from lattica.schema import Box

#: Classes of energy, each a column of ParticleSystem.work().
CLASSES = ("nonbond", "bond", "angle", "dihedral")


@dataclass(frozen=True)
class ParticleSystem:
    """particles carry m; pair_pot has each type pair in both orders; term makes energy and force of a joined pair.

    exclusions (i, j) take no part in pairs; bonds and bond_pot are bond_terms'; angles carry force and theta0, dihedrals
    force, n and delta, as a parameter file's assignment gives them. constraints (rid, i, j, d2) are kept in each step;
    heat is (target, strength) of the thermostat; dpd (alpha, gamma, seed) adds dissipative forces; with a skin the pairs
    of one state serve the steps after it until a particle has moved too far. kernel is term on arrays by name instead of a
    joined table; with it kept pairs are worked out where they are kept, without a row for each.
    """

    particles: DataFrame
    box: Box
    pair_pot: DataFrame
    term: Callable[[DataFrame], Term]
    exclusions: DataFrame | None = None
    bonds: DataFrame | None = None
    bond_pot: DataFrame | None = None
    angles: DataFrame | None = None
    dihedrals: DataFrame | None = None
    constraints: DataFrame | None = None
    preconditioned: bool = False
    heat: tuple[float, float] | None = None
    dpd: tuple[float, float, int] | None = None
    skin: float = 0.0
    kept: SkinList | None = None
    kernel: Callable[[Mapping[str, np.ndarray]], Term] | None = None

    def pairs(self) -> DataFrame:
        found = self.kept.pairs(self.particles) if self.kept else neighbour_pairs(self.particles, self.box, PAIR, self.exclusions)
        return with_potential(found, self.pair_pot)

    def terms(self) -> DataFrame:
        rows = self.pairs()
        t = self.term(rows)
        return rows.withColumns({"e": t.e, "f": t.f})

    def parts(self) -> dict[str, tuple[DataFrame, dict[str, bonded.Vec]]]:
        """Every class's interactions, with the force on each of their ends."""
        return {"nonbond": bonded.bond_parts(self.terms())} | self.bonded_parts()

    def bonded_parts(self) -> dict[str, tuple[DataFrame, dict[str, bonded.Vec]]]:
        out = {}
        if self.bonds is not None and self.bond_pot is not None:
            out["bond"] = bonded.bond_parts(bonded.bond_terms(self.bonds, self.particles, self.bond_pot, self.box))
        if self.angles is not None:
            out["angle"] = bonded.angle_parts(bonded.angle_terms(self.angles, self.particles, self.box, F.col("force"), F.col("theta0")))
        if self.dihedrals is not None:
            out["dihedral"] = bonded.dihedral_parts(bonded.dihedral_terms(self.dihedrals, self.particles, self.box, F.col("force"), F.col("n"), F.col("delta")))
        return out

    def work(self) -> DataFrame:
        """(id, fx, fy, fz, nonbond, bond, angle, dihedral): the force on each particle and, by class, the energy of the
        interactions whose first end it is. Forces and energies come from one pass over the interactions."""
        summed = self.kept.sums(self.particles, self.pair_pot, self.kernel) if self.kept and self.kernel else None
        ends = [bonded.ends(*p).withColumn("kind", F.lit(k)) for k, p in (self.parts() if summed is None else self.bonded_parts()).items()]
        if summed is not None:
            ends.insert(0, summed.withColumn("kind", F.lit("nonbond")))
        energies = [F.sum(F.when(F.col("kind") == k, F.col("e")).otherwise(0.0)).alias(k) for k in CLASSES]
        return reduce(DataFrame.union, ends).groupBy("id").agg(*[F.sum(c).alias(c) for c in FORCES], *energies)

    def forces(self) -> DataFrame:
        return self.work().select("id", *FORCES)

    def moved(self, dt: float, work: DataFrame | None = None, number: int = 0) -> DataFrame:
        """The particles after forces (of work, if it is there), before constraints, thermostat and wrap."""
        forces = (self.work() if work is None else work).select("id", *FORCES)
        if self.dpd:
            alpha, gamma, seed = self.dpd
            rows = dpd_pairs(projected(self.particles, forces, dt), self.box, alpha, gamma, dt, seed, number).withColumn("e", F.lit(0.0))
            forces = forces.union(bonded.spread(*bonded.bond_parts(rows))).groupBy("id").agg(*[F.sum(c).alias(c) for c in FORCES])
        return moved(self.particles.withColumns({f"o{c}": F.col(c) for c in "xyz"}), forces, dt)

    def step(self, dt: float, work: DataFrame | None = None, number: int = 0) -> ParticleSystem:
        """One leapfrog step, lazy: forces (of work, if it is there), positions, constraints, thermostat, wrap. number
        tells apart the noise of the steps of a run."""
        now = self.moved(dt, work, number).drop("ox", "oy", "oz")
        if self.constraints is not None:
            now = constrained(now, self.particles, self.constraints, self.box, dt, self.preconditioned)
        if self.heat:
            now = thermostat(now, observables.temperature(now, self.fixed()), *self.heat)
        return replace(self, particles=wrapped(now, self.box).select(*self.particles.columns))

    def held_step(self, dt: float, work: DataFrame, number: int, hold: Held, groups: DataFrame | None) -> ParticleSystem:
        """The same step, settled on its way: what is moved, then what is constrained, so that no query shuffles for both.
        groups are the constraints' members(). The state before it and work are removed."""
        now = self.moved(dt, work, number)
        if self.constraints is not None and groups is not None:
            now = hold(now.join(groups, "id", "left"), "moved")
            hold.drop("state", "work")
            now = solved(now, self.constraints, self.box, dt, self.preconditioned)
        now = hold(wrapped(now, self.box).select(*self.particles.columns), "state")
        hold.drop("moved", "work")
        if self.heat:  # one row, known; velocities are scaled as the state is read
            found = observables.temperature(now, self.fixed())
            known = now.sparkSession.createDataFrame([found.first()], found.schema)
            now = thermostat(now, known, *self.heat).select(*self.particles.columns)
        return replace(self, particles=now).listed(hold)

    def fixed(self) -> int:
        """Degrees of freedom that the constraints take."""
        return 0 if self.constraints is None else self.constraints.count()

    def settled(self) -> ParticleSystem:
        """The particles written and reread, so that plans don't grow with steps and any executor can be lost; with a
        skin, the list of pairs is made anew where it is stale."""
        return replace(self, particles=settled(self.particles)).listed(settled)

    def listed(self, hold: Callable[[DataFrame, str], DataFrame]) -> ParticleSystem:
        """With a skin, the list of pairs is made anew where it is stale, and particles carry where they were then."""
        if not self.skin or (self.kept and not self.kept.stale(self.particles)):
            return self
        if isinstance(hold, Held):
            hold.drop("skin")
        ps = bricks.homed(self.particles, self.box)
        return replace(self, particles=ps, kept=SkinList.made(ps, self.box, self.skin, self.exclusions, hold))

    def stats(self, step: int, work: DataFrame | None = None) -> DataFrame:
        """(step, nonbond, bond, angle, dihedral, epot, ekin, temperature)."""
        sums = (self.work() if work is None else work).agg(*[F.sum(k).alias(k) for k in CLASSES])
        epot = sums.select("*", reduce(lambda a, b: a + b, [F.col(k) for k in CLASSES]).alias("epot"))
        return epot.crossJoin(observables.temperature(self.particles, self.fixed())).select(F.lit(step).alias("step"), *CLASSES, "epot", "ekin", "temperature")

    def trajectory(self, steps: int, dt: float, every: int = 0, folder: str | None = None) -> tuple[ParticleSystem, DataFrame]:
        """The system after some steps and a row of stats for each. Interactions are worked out once for each state: a
        step takes the forces that the stats before it were made with. With every, the particles of every such step are
        added to folder, by step. Of the states, their work and lists of pairs, only those that are still read are kept."""
        hold, rows, cols = Held(self.particles.count()), None, [c for c in self.particles.columns if c not in bricks.HOME]
        groups = None if self.constraints is None else hold(members(self.constraints), "members")
        now = replace(self, particles=hold(self.particles.select(*cols), "state"), kept=None).listed(hold)
        work = hold(now.work(), "work")
        for s in range(1, steps + 1):
            now = now.held_step(dt, work, s, hold, groups)
            work = hold(now.work(), "work")
            row = settled(now.stats(s, work), "stats")
            rows = row if rows is None else rows.union(row)
            if every and s % every == 0:
                snapshot(now.particles.select(*cols), s, str(folder))
        assert rows is not None
        hold.drop("work", "skin", "members")
        return replace(now, particles=now.particles.select(*cols), kept=None), rows


def snapshot(ps: DataFrame, step: int, folder: str) -> None:
    """Adds a state to a folder of states, parted by step; a step written again is replaced."""
    ps.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/step={step}")


@dataclass(frozen=True)
class SkinList:
    """Pairs within cutoff + skin of a state, kept by bricks of the box until a particle has moved too far. then has where
    particles were; a state that carries it (bricks.HOME) is not joined with it."""

    box: Box
    skin: float
    then: DataFrame
    counts: tuple[int, int, int]
    lists: DataFrame

    @classmethod
    def made(cls, ps: DataFrame, box: Box, skin: float, exclusions: DataFrame | None = None, hold: Callable[[DataFrame, str], DataFrame] = settled) -> SkinList:
        reach, ps = box.cutoff + skin, bricks.homed(ps, box)
        counts = bricks.counts(ps.count(), box, reach)
        then = ps.select("id", *bricks.HOME)
        if exclusions is not None:
            out = exclusions.groupBy(F.col("i").alias("id")).agg(F.collect_set("j").alias("out"))
            ps = ps.join(out, "id", "left")
        rows = bricks.entries(ps, box, reach, counts, *(["out"] if exclusions is not None else []))
        return cls(box, skin, then, counts, hold(bricks.listed(rows, reach), "skin"))

    def carried(self, now: DataFrame) -> DataFrame:
        return now if set(bricks.HOME) <= set(now.columns) else now.join(self.then, "id")

    def stale(self, now: DataFrame) -> bool:
        found = observables.displacement(self.carried(now), bricks.HOME, self.box)
        return bool(observables.rebuild_needed(found, self.skin, self.box.cutoff).first()["rebuild"])

    def entries(self, now: DataFrame) -> DataFrame:
        return bricks.entries(self.carried(now), self.box, self.box.cutoff + self.skin, self.counts)

    def pairs(self, now: DataFrame) -> DataFrame:
        """The pairs within the cutoff now, from the kept list."""
        return bricks.pairs(self.entries(now), self.lists, self.box.cutoff)

    def sums(self, now: DataFrame, pair_pot: DataFrame, kernel: Callable[[Mapping[str, np.ndarray]], Term]) -> DataFrame | None:
        """Forces and energies of those pairs, summed by particle and brick: bricks.sums(). None if the potentials are too
        many for each task, or a pair of types has several."""
        table = pair_pot.limit(SMALL + 1).toArrow()
        kinds = set(zip(table["type_i"].to_pylist(), table["type_j"].to_pylist(), strict=True))
        if len(kinds) < table.num_rows or table.num_rows > SMALL:
            return None
        return bricks.sums(self.entries(now), self.lists, self.box.cutoff, table, kernel)
