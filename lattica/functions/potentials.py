"""Energies and (dE/dr) / r as column expressions of r2. A term is a pair (energy, force factor). lj() and coulomb() take
arrays of numbers as well, and give arrays."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.schema import COULOMB


class Term(NamedTuple):
    e: Column
    f: Column

    def __add__(self, other: Term) -> Term:  # type: ignore[override]
        return Term(self.e + other.e, self.f + other.f)


# Coefficients of the rational approximation of erf (error below 1.5e-7): fixed values.
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERFC_P = 0.3275911


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0; neither engine has one built in."""
    t = 1.0 / (1.0 + F.lit(ERFC_P) * x)
    poly = F.lit(ERFC[4])
    for c in reversed(ERFC[:4]):
        poly = poly * t + F.lit(c)
    return poly * t * F.exp(-x * x)


def lj(r2: Column, a: Column | float, b: Column | float) -> Term:
    """a / r^12 - b / r^6."""
    ir2 = 1.0 / r2
    ir6 = ir2 * ir2 * ir2
    return Term(ir6 * (a * ir6 - b), ir6 * (-12.0 * a * ir6 + 6.0 * b) * ir2)


def coulomb(r2: Column, q: Column) -> Term:
    e = COULOMB * q / (F.sqrt(r2) if isinstance(r2, Column) else np.sqrt(r2))
    return Term(e, -e / r2)


def coulomb_shifted(r2: Column, q: Column, cutoff: float) -> Term:
    """Zero at the cutoff."""
    plain = coulomb(r2, q)
    return Term(plain.e - F.lit(COULOMB) * q / F.lit(cutoff), plain.f)


def ewald(r2: Column, q: Column, kappa: float) -> Term:
    """Real-space part: q erfc(kappa r) / r."""
    r = F.sqrt(r2)
    e = F.lit(COULOMB) * q * erfc(F.lit(kappa) * r) / r
    slope = F.lit(COULOMB) * q * F.lit(2.0 * kappa / math.sqrt(math.pi)) * F.exp(-F.lit(kappa * kappa) * r2)
    return Term(e, -(e + slope) / r2)


def switch(r2: Column, on: float, off: float) -> Term:
    """1 below on, 0 above off, smooth between."""
    a2, b2 = on * on, off * off
    w = (b2 - a2) ** 3
    s = (b2 - r2) * (b2 - r2) * (b2 + 2.0 * r2 - 3.0 * a2) / w
    ds = 12.0 * (b2 - r2) * (a2 - r2) / w  # (ds / dr) / r
    return Term(F.when(r2 < a2, 1.0).when(r2 > b2, 0.0).otherwise(s), F.when((r2 < a2) | (r2 > b2), 0.0).otherwise(ds))


def nonbonded(r2: Column, a: Column, b: Column, q: Column, kappa: float, cutoff: float, on: float | None = None) -> Term:
    """Lennard-Jones with the electrostatics that kappa selects: none below zero, shifted at zero, the real-space part of
    an Ewald sum above. on: where Lennard-Jones starts to be switched off; not switched, if left out."""
    plain = lj(r2, a, b) if on is None else lj_switched(r2, a, b, on, cutoff)
    if kappa < 0:
        return plain
    return plain + (coulomb_shifted(r2, q, cutoff) if kappa == 0 else ewald(r2, q, kappa))


def switched(term: Term, s: Term) -> Term:
    return Term(term.e * s.e, term.f * s.e + term.e * s.f)


def lj_switched(r2: Column, a: Column | float, b: Column | float, on: float, off: float) -> Term:
    return switched(lj(r2, a, b), switch(r2, on, off))


def harmonic(r: Column, k: Column | float, r0: Column | float) -> Term:
    """k (r - r0)^2 of a bond."""
    k, r0 = (x if isinstance(x, Column) else F.lit(x) for x in (k, r0))
    d = r - r0
    return Term(k * d * d, 2.0 * k * d / r)


def value(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def angle_energy(c: Column, k: Column | float, theta0: Column | float) -> tuple[Column, Column]:
    """k (acos c - theta0)^2 and its derivative by c."""
    d = F.acos(c) - value(theta0)
    return value(k) * d * d, -2.0 * value(k) * d / F.sqrt(1.0 - c * c)


def chebyshev(n: int, c: Column) -> tuple[Column, Column]:
    """cos(n phi) and sin(n phi) / sin(phi) from c = cos(phi)."""
    t0, t1, u0, u1 = F.lit(1.0), c, F.lit(0.0), F.lit(1.0)
    if n == 0:
        return t0, u0
    for _ in range(n - 1):
        t0, t1 = t1, 2.0 * c * t1 - t0
        u0, u1 = u1, 2.0 * c * u1 - u0
    return t1, u1


def dihedral_energy(c: Column, k: float, n: int, delta: float) -> tuple[Column, Column]:
    """k (1 + cos(n phi - delta)) with phi = acos c in [0, pi], and its derivative by c."""
    t, u = chebyshev(n, c)
    if abs(math.sin(delta)) < 1e-12:
        sign = round(math.cos(delta))
        return F.lit(k) * (1.0 + sign * t), F.lit(k * sign * n) * u
    s = F.sqrt(1.0 - c * c)
    e = F.lit(k) * (1.0 + F.lit(math.cos(delta)) * t + F.lit(math.sin(delta)) * u * s)
    sin_n = u * s
    de = F.lit(k * n) * (F.lit(math.cos(delta)) * u - F.lit(math.sin(delta)) * t / s)
    return e, de + 0.0 * sin_n


#: The largest multiplicity that a table of dihedrals may hold.
MOST_FOLDS = 6


def dihedral_energy_of(c: Column, k: Column, n: Column, delta: Column) -> tuple[Column, Column]:
    """The same with k, n (0 to MOST_FOLDS) and delta from columns."""
    t, u = F.lit(None).cast("double"), F.lit(None).cast("double")
    for m in range(MOST_FOLDS + 1):
        tm, um = chebyshev(m, c)
        t, u = F.when(n == m, tm).otherwise(t), F.when(n == m, um).otherwise(u)
    s = F.greatest(F.sqrt(1.0 - c * c), F.lit(1e-12))  # where it vanishes, so does sin(delta) in any field that has a force there
    flat = F.abs(F.sin(delta)) < 1e-12
    a, b = F.cos(delta), F.when(flat, 0.0).otherwise(F.sin(delta))
    return k * (1.0 + a * t + b * u * s), k * n * (a * u - b * t / s)


def improper_energy(c: Column, k: Column | float, psi0: Column | float) -> tuple[Column, Column]:
    return angle_energy(c, k, psi0)
