"""Particles from and to tables, with defaults for columns that are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.binning import wrapped
from lattica.operators.state import running
from lattica.schema import GHOST, Box

DEFAULTS = {"vid": 0, "type": None, "flags": 0, "q": 0.0, "vx": 0.0, "vy": 0.0, "vz": 0.0}
ORDER = ("id", "vid", "type", "flags", "q", "x", "y", "z", "vx", "vy", "vz")
KINDS = {"id": "long", "vid": "long", "type": "int", "flags": "int"}


def loaded(rows: DataFrame, ghosts: bool = False) -> DataFrame:
    """A particle table from columns x, y, z, type and any others; a missing or null value takes its default. Without an
    id column, ids are the rows' places in order of x, y and z. ghosts sets the ghost flag on every row."""
    out = rows if "id" in rows.columns else running(rows, "id", "x", "y", "z")
    for c, d in DEFAULTS.items():
        if d is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d))
    if ghosts:
        out = out.withColumn("flags", F.col("flags").bitwiseOR(F.lit(GHOST)))
    return out.select(*[F.col(c).cast(KINDS.get(c, "double")).alias(c) for c in ORDER])


def added(ps: DataFrame, more: DataFrame) -> DataFrame:
    """Particles inserted, in batches rather than one by one."""
    return ps.unionByName(loaded(more))


def unloaded(ps: DataFrame, columns: tuple[str, ...] = ORDER) -> DataFrame:
    """Only the columns asked for are read."""
    return ps.select(*columns)


def unloaded_cells(binned_ps: DataFrame, marked: DataFrame, columns: tuple[str, ...] = ORDER) -> DataFrame:
    """Particles of the cells in marked (cell), with their cell."""
    return binned_ps.join(marked.select("cell").distinct(), "cell", "left_semi").select("cell", *columns)


def strays(binned_ps: DataFrame, cells: DataFrame, columns: tuple[str, ...] = ORDER) -> DataFrame:
    """The particles that are not ghosts among those of some cells, with their cell."""
    return unloaded_cells(real(binned_ps), cells, columns)


def real(ps: DataFrame) -> DataFrame:
    """Particles that are not ghosts."""
    return ps.where(F.col("flags").bitwiseAND(F.lit(GHOST)) == 0)


def wrapped_real(ps: DataFrame, box: Box) -> DataFrame:
    """Positions of particles that are not ghosts moved into the box; ghosts stay where they are."""
    moved = wrapped(ps.withColumns({f"_{c}": F.col(c) for c in "xyz"}), box)
    ghost = F.col("flags").bitwiseAND(F.lit(GHOST)) > 0
    return moved.withColumns({c: F.when(ghost, F.col(f"_{c}")).otherwise(F.col(c)) for c in "xyz"}).drop("_x", "_y", "_z")


def flushed(ps: DataFrame, ghosts_only: bool = False) -> DataFrame:
    return real(ps) if ghosts_only else ps.limit(0)


def position(ps: DataFrame, id_: int) -> DataFrame:
    return ps.where(F.col("id") == id_).select("x", "y", "z")
