"""Builders of species, potentials and topology: each call adds a row, tables() gives the DataFrames that plans read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lattica.schema import ANGLES, BONDS, DIHEDRALS, TYPES


@dataclass
class ForceField:
    """Species and potentials. Potentials of a pair of species hold in both orders; given again, the last counts."""

    species: list[tuple] = field(default_factory=list)
    pairs: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)
    bonds: dict[tuple[int, int], tuple[float, float, float, float]] = field(default_factory=dict)
    angles: list[tuple[float, float]] = field(default_factory=list)
    dihedrals: list[tuple[float, int, float]] = field(default_factory=list)

    def add_type(self, name: str, mass: float, charge: float = 0.0, eps: float = 0.0, rmin: float = 0.0, name2: str | None = None) -> int:
        """The species' number. Names with the same name2 (name, if left out) may not repeat."""
        name2 = name if name2 is None else name2
        if any(s[2] == name2 for s in self.species):
            raise ValueError(f"species {name2} is there already")
        self.species.append((len(self.species), name, name2, float(mass), float(charge), float(eps), float(rmin)))
        return len(self.species) - 1

    def _known(self, *types: int) -> None:
        if any(not 0 <= t < len(self.species) for t in types):
            raise ValueError(f"no such species among {types}")

    def add_pair(self, i: int, j: int, a: float, b: float) -> None:
        self._known(i, j)
        self.pairs[i, j] = self.pairs[j, i] = (float(a), float(b))

    def add_bond(self, i: int, j: int, k: float, r0: float, lo: float = 0.0, hi: float = float("inf")) -> None:
        self._known(i, j)
        self.bonds[i, j] = self.bonds[j, i] = (float(k), float(r0), float(lo), float(hi))

    def add_angle(self, k: float, theta0: float) -> int:
        """The potential's number, for the pid of angles."""
        self.angles.append((float(k), float(theta0)))
        return len(self.angles) - 1

    def add_dihedral(self, k: float, n: int, delta: float) -> int:
        self.dihedrals.append((float(k), int(n), float(delta)))
        return len(self.dihedrals) - 1

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """types, pair_pot and bond_pot (in both orders), angle_pot and dihedral_pot (by pid)."""
        both = lambda d: [(i, j, *v) for (i, j), v in sorted(d.items())]
        return {
            "types": spark.createDataFrame(self.species, TYPES),
            "pair_pot": spark.createDataFrame(both(self.pairs), "type_i int, type_j int, a double, b double"),
            "bond_pot": spark.createDataFrame(both(self.bonds), "type_i int, type_j int, k double, r0 double, a double, b double"),
            "angle_pot": spark.createDataFrame([(p, *v) for p, v in enumerate(self.angles)], "pid int, force double, theta0 double"),
            "dihedral_pot": spark.createDataFrame([(p, *v) for p, v in enumerate(self.dihedrals)], "pid int, force double, n int, delta double"),
        }


@dataclass
class TopologyBuilder:
    """Bonds, angles (vertex in the middle), dihedrals and exclusions, added one by one or taken from a table."""

    bonds: list[tuple] = field(default_factory=list)
    angles: list[tuple] = field(default_factory=list)
    dihedrals: list[tuple] = field(default_factory=list)
    exclusions: set[tuple[int, int]] = field(default_factory=set)

    def add_bond(self, i: int, j: int) -> int:
        self._apart(i, j)
        self.bonds.append((len(self.bonds), i, j))
        return len(self.bonds) - 1

    def add_angle(self, i: int, j: int, k: int, pid: int = -1) -> int:
        self._apart(i, j, k)
        self.angles.append((len(self.angles), i, j, k, pid))
        return len(self.angles) - 1

    def add_dihedral(self, i: int, j: int, k: int, l: int, pid: int = -1, improper: bool = False) -> int:  # noqa: E741
        self._apart(i, j, k, l)
        self.dihedrals.append((len(self.dihedrals), i, j, k, l, pid, improper))
        return len(self.dihedrals) - 1

    def add_exclusion(self, i: int, j: int) -> None:
        self._apart(i, j)
        self.exclusions.add((min(i, j), max(i, j)))

    @staticmethod
    def _apart(*ids: int) -> None:
        if min(ids) < 0 or len(set(ids)) < len(ids):
            raise ValueError(f"particles of an interaction have to be different and not negative: {ids}")

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "bonds": spark.createDataFrame(self.bonds, BONDS), "angles": spark.createDataFrame(self.angles, ANGLES), "dihedrals": spark.createDataFrame(self.dihedrals, DIHEDRALS),
            "exclusions": spark.createDataFrame(sorted(self.exclusions), "i long, j long"),
        }


def more(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of topology appended to a table in one go, numbered after its last key."""
    from pyspark.sql import functions as F

    from lattica.operators.state import running

    start = (table.agg(F.max(key)).first()[0] if not table.isEmpty() else None) or 0
    ends = [c for c in "ijkl" if c in rows.columns]
    new = running(rows, "_n", *ends).withColumn(key, (F.col("_n") + F.lit(start + (not table.isEmpty()))).cast("long"))
    return table.unionByName(new.select(*table.columns))
