"""Tables and the box."""

from __future__ import annotations

import math
from dataclasses import dataclass

PARTICLES = "id long, vid long, type int, flags int, q double, x double, y double, z double, vx double, vy double, vz double"
TYPES = "type int, name string, name2 string, mass double, charge double, eps double, rmin double"
BONDS = "bid long, i long, j long"
ANGLES = "aid long, i long, j long, k long, pid int"
DIHEDRALS = "did long, i long, j long, k long, l long, pid int, improper boolean"
RIGIDS = "rid long, parts array<long>, constr array<struct<i:int,j:int,d2:double>>"
FROZEN, GHOST = 1, 2

#: Coulomb's constant in the system of units used (nm, ps, kJ), a fixed value: 1 / (4 pi).
COULOMB = 0.0795774715459477
#: Boltzmann's constant times Avogadro's number, kJ / (mol K): a fixed value.
GAS = 0.00831446261815324


@dataclass(frozen=True)
class Box:
    """A periodic box and its grid of cells, with edges of at least margin * cutoff (or edge).

    The margin keeps a pair at exactly the cutoff from being two cells apart through rounding.
    """

    origin: tuple[float, float, float]
    dim: tuple[float, float, float]
    cutoff: float
    periodic: tuple[bool, bool, bool] = (True, True, True)
    margin: float = 1.001
    edge: float | None = None

    def __post_init__(self) -> None:
        for n, s, p in zip(self.cells, self.span, self.periodic, strict=True):
            if p and n < max(3, 2 * s + 1):
                raise ValueError("a periodic axis needs three cells or more, and as many as the cutoff spans on both sides")

    @property
    def cells(self) -> tuple[int, int, int]:
        return tuple(max(1, math.floor(d / (self.edge or self.margin * self.cutoff))) for d in self.dim)  # type: ignore[return-value]

    @property
    def width(self) -> tuple[float, float, float]:
        return tuple(d / n for d, n in zip(self.dim, self.cells, strict=True))  # type: ignore[return-value]

    @property
    def span(self) -> tuple[int, int, int]:
        return tuple(math.ceil(self.cutoff / h) for h in self.width)  # type: ignore[return-value]
