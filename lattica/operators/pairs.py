"""Neighbour pairs: a periodic distance join, run as an equi-join on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.binning import _neighbours, binned, differences
from lattica.operators.state import small
from lattica.schema import Box

PAIR = ("id", "type", "q", "x", "y", "z")


def neighbour_pairs(ps: DataFrame, box: Box, columns: tuple[str, ...] = PAIR, exclusions: DataFrame | None = None) -> DataFrame:
    """(i, j, type_i, type_j, ..., dx, dy, dz, r2): each unordered pair within the cutoff once; d = x_i - x_j. Pairs in
    exclusions (i, j) are left out: a particle's few excluded partners go with its row through the join on cells, so the
    pairs themselves are not shuffled.

    Only the columns that pairs need are shuffled. Rows are dealt by their own cell before they are copied to the half
    shell of neighbour cells, so that a small number of input files does not bound the parallelism.
    """
    cells = binned(ps.select(*columns), box)
    left = _neighbours(cells.repartition("cx", "cy", "cz"), box).drop("cx", "cy", "cz", "cell").alias("a")
    right = cells.drop("cell")
    if exclusions is not None:  # on the side that is not copied to neighbour cells
        ends = F.explode(F.array(F.struct(F.col("i").alias("id"), F.col("j").alias("o")), F.struct(F.col("j").alias("id"), F.col("i").alias("o"))))
        partners = exclusions.select(ends.alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.collect_set("e.o").alias("_out"))
        right = right.join(partners, "id", "left")
    # merged, never broadcast: the copies' size is not in Spark's estimate, and a merge spills
    right = right.hint("merge").alias("b")
    met = left.join(right, (F.col("a.nx") == F.col("b.cx")) & (F.col("a.ny") == F.col("b.cy")) & (F.col("a.nz") == F.col("b.cz")) & (~F.col("a.own") | (F.col("a.id") < F.col("b.id"))))
    extra = [c for c in columns if c not in ("id", "x", "y", "z")]
    d = differences("a", "b", box)
    named = met.select(
        F.col("a.id").alias("i"), F.col("b.id").alias("j"), *[F.col(f"{t}.{c}").alias(f"{c}_{n}") for c in extra for t, n in (("a", "i"), ("b", "j"))],
        *[x.alias(n) for x, n in zip(d, ("dx", "dy", "dz"), strict=True)], *([F.col("b._out").alias("_out")] if exclusions is not None else []),
    )
    r2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    found = named.withColumn("r2", r2).where(F.col("r2") <= F.lit(box.cutoff * box.cutoff))
    if exclusions is None:
        return found
    # after the distance, which leaves a fraction of the candidates
    return found.where(F.col("_out").isNull() | ~F.array_contains("_out", F.col("i"))).drop("_out")


def all_pairs(ps: DataFrame, box: Box, columns: tuple[str, ...] = PAIR) -> DataFrame:
    """The same by comparing every two rows: for tests on small systems only."""
    rows = ps.select(*columns)
    met = rows.alias("a").join(rows.alias("b"), F.col("a.id") < F.col("b.id"))
    d = differences("a", "b", box)
    named = met.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), *[x.alias(n) for x, n in zip(d, ("dx", "dy", "dz"), strict=True)])
    return named.withColumn("r2", F.expr("dx * dx + dy * dy + dz * dz")).where(F.col("r2") <= F.lit(box.cutoff * box.cutoff))


def with_potential(pairs: DataFrame, pair_pot: DataFrame) -> DataFrame:
    """Pairs whose types interact, with the parameters. pair_pot holds each type pair in both orders; it has a row per
    pair of species and is broadcast if it is small, so that pairs are not shuffled."""
    return pairs.join(small(pair_pot), ["type_i", "type_j"])


def both_ends(pairs: DataFrame, f: str = "f") -> DataFrame:
    """(id, fx, fy, fz) summed over pairs: -f * d on i and +f * d on j, where f is (dE/dr) / r."""
    part = lambda s: F.struct(*[(s * F.col(f) * F.col(d)).alias(n) for d, n in (("dx", "fx"), ("dy", "fy"), ("dz", "fz"))])
    ends = pairs.select(F.explode(F.array(F.struct(F.col("i").alias("id"), part(F.lit(-1.0)).alias("w")), F.struct(F.col("j").alias("id"), part(F.lit(1.0)).alias("w")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(*[F.sum(f"e.w.{c}").alias(c) for c in ("fx", "fy", "fz")])


def without_exclusions(pairs: DataFrame, exclusions: DataFrame) -> DataFrame:
    """The same for pairs that are there already; exclusions (i, j) with i <= j."""
    key = pairs.withColumns({"_lo": F.least("i", "j"), "_hi": F.greatest("i", "j")})
    gone = exclusions.select(F.col("i").alias("_lo"), F.col("j").alias("_hi"))
    return key.join(gone, ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")


def distinct_exclusions(*lists: DataFrame) -> DataFrame:
    """(i, j), i < j, of any number of (i, j) tables, each once."""
    union = lists[0].select("i", "j")
    for x in lists[1:]:
        union = union.union(x.select("i", "j"))
    return union.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def exclusions_of(bonds: DataFrame | None = None, angles: DataFrame | None = None, dihedrals: DataFrame | None = None, constraints: DataFrame | None = None) -> DataFrame:
    """(i, j), i < j, each once: the ends of all that is bonded or held at a distance."""
    ends = [(bonds, "j"), (angles, "k"), (dihedrals, "l"), (constraints, "j")]
    return distinct_exclusions(*[top.select("i", F.col(e).alias("j")) for top, e in ends if top is not None])
