"""Force-field parameter files: sectioned (CHARMM) and keyword-per-line (X-PLOR)."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.sources.text import lines, tokens, uncommented

# Unit conversions, fixed values: Angstrom to nm, kcal to kJ, kcal / A^2 to kJ / nm^2.
NM, KJ, KJ_NM2 = 0.1, 4.184, 418.4
RAD = math.pi / 180.0


class Parameters(NamedTuple):
    bonds: DataFrame
    angles: DataFrame
    dihedrals: DataFrame
    impropers: DataFrame
    nonbonded: DataFrame


def _num(k: int) -> Column:
    return F.get(F.col("t"), k).cast("double")


def _tables(rows: DataFrame, at: int, rmin: Column) -> Parameters:
    """Tables from (line, s, t): s one of BOND, ANGL, DIHE, IMPR, NONB; names start at token at."""
    name = lambda k: F.get(F.col("t"), at + k).alias(f"t{k + 1}")
    of = lambda s: rows.where(F.col("s") == s)
    bonds = of("BOND").select("line", name(0), name(1), (_num(at + 2) * KJ_NM2).alias("force"), (_num(at + 3) * NM).alias("r0"))
    angles = of("ANGL").select("line", name(0), name(1), name(2), (_num(at + 3) * KJ).alias("force"), (_num(at + 4) * RAD).alias("theta0"))
    dihedrals = of("DIHE").select("line", *[name(k) for k in range(4)], (_num(at + 4) * KJ).alias("force"), F.get(F.col("t"), at + 5).cast("int").alias("n"), (_num(at + 6) * RAD).alias("delta"))
    impropers = of("IMPR").select("line", *[name(k) for k in range(4)], (_num(at + 4) * KJ).alias("force"), (_num(at + 6) * RAD).alias("psi0"))
    nonbonded = of("NONB").select("line", name(0), rmin.alias("rmin"), (F.abs(_num(at + 2 if at == 0 else at + 1)) * KJ).alias("eps"))
    return Parameters(bonds, angles, dihedrals, impropers, nonbonded)


def read_charmm(spark: SparkSession, path: str) -> Parameters:
    """Sections BONDS, ANGLES, DIHEDRALS, IMPROPER, NONBONDED and HBOND; leading * lines and ! comments are skipped."""
    rows = lines(spark, path).where("not startswith(text, '*')").select("line", tokens(uncommented(F.col("text"), "!")).alias("t")).where(F.size("t") > 0)
    first = F.upper(F.substring(F.get(F.col("t"), 0), 1, 4))
    head = F.when(first.isin("BOND", "ANGL", "DIHE", "IMPR", "NONB", "HBON", "END"), first)
    section = F.last(head, ignorenulls=True).over(Window.orderBy("line"))
    body = rows.select("line", "t", head.alias("h"), section.alias("s")).where("h is null and s is not null")
    # continued option lines of the section's head hold no numbers in third place
    body = body.where("s <> 'NONB' or try_cast(get(t, 2) as double) is not null")
    return _tables(body, 0, _num(3) * NM)


def read_xplor(spark: SparkSession, path: str) -> Parameters:
    """A keyword per line, matched by its first four letters in any case, in any order; ! and { start comments; other
    keywords are skipped. The second number of a NONB line is a sigma and is halved."""
    rows = lines(spark, path).select("line", tokens(uncommented(F.col("text"), "!{")).alias("t")).where(F.size("t") > 1)
    body = rows.select("line", "t", F.upper(F.substring(F.get(F.col("t"), 0), 1, 4)).alias("s")).where(F.col("s").isin("BOND", "ANGL", "DIHE", "IMPR", "NONB"))
    return _tables(body, 1, _num(3) * (0.5 * NM))
