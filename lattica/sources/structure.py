"""Topology (PSF) and coordinates (PDB)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.binning import wrap
from lattica.operators.state import running, settled
from lattica.schema import Box
from lattica.sources.text import numbered, tokens


class Topology(NamedTuple):
    atoms: DataFrame
    types: DataFrame
    bonds: DataFrame
    angles: DataFrame
    dihedrals: DataFrame


HEAD = r"^\s*(\d+)\s*!\s*(\w+)"


def read_psf(spark: SparkSession, path: str) -> Topology:
    """atoms (id, name, type, q, m), types in order of first appearance of (type name, charge), bonds, angles with pid -1,
    dihedrals with pid -1, or -2 for impropers. Ids start at 0. Sections are numbered lines "count !KEYWORD".

    Lines are numbered by running counts, and so are the numbers of a section, so a file of any size is read in parts;
    only the sections' heads are brought to the driver.
    """
    rows = settled(numbered(spark, path), "psf")
    heads = rows.where(F.col("text").rlike(HEAD)).select("line", F.regexp_extract("text", HEAD, 1).cast("long").alias("n"), F.regexp_extract("text", HEAD, 2).alias("k")).orderBy("line").collect()
    ends = [h["line"] for h in heads[1:]] + [None]

    def section(key: str) -> tuple[int, DataFrame]:
        """Its count, and its lines as tokens."""
        for h, end in zip(heads, ends, strict=True):
            if h["k"] == key or (key == "NIMP" and h["k"].startswith(key)):
                inside = (F.col("line") > h["line"]) & (F.lit(True) if end is None else F.col("line") < end)
                body = rows.where(inside).select("line", tokens(F.regexp_replace("text", "!.*$", "")).alias("t"))
                return h["n"], body.where(F.size("t") > 0)
        return 0, rows.where(F.lit(False)).select("line", tokens(F.col("text")).alias("t"))

    def of(key: str, letters: str) -> tuple[int, DataFrame]:
        """The count, and (r, i, j, ...) of a section's numbers in rows, however they are broken into lines; 0-based."""
        n, body = section(key)
        width = len(letters)
        counted = running(body, "before", "line", of=F.size("t")) if n else body.withColumn("before", F.lit(0))
        each = counted.select("before", F.posexplode("t").alias("at", "x")).select((F.col("before") + F.col("at")).alias("at"), F.col("x").cast("long").alias("x"))
        each = each.where(F.col("at") < n * width).select(F.floor(F.col("at") / width).alias("r"), (F.col("at") % width).alias("c"), (F.col("x") - 1).alias("x"))
        return n, each.groupBy("r").agg(*[F.max(F.when(F.col("c") == k, F.col("x"))).alias(e) for k, e in enumerate(letters)])

    t = lambda k: F.get(F.col("t"), F.lit(k))
    raw = section("NATOM")[1].select((t(0).cast("long") - 1).alias("id"), (t(2).cast("long") - 1).alias("vid"), t(4).alias("atom"), t(5).alias("name"), t(6).alias("charge"), t(7).cast("double").alias("m"))
    name2 = F.concat("name", "charge")
    found = raw.groupBy(name2.alias("name2")).agg(F.min("id").alias("at"), F.first("name").alias("name"), F.first("m").alias("mass"), F.first("charge").cast("double").alias("charge"))
    types = found.select((F.row_number().over(Window.orderBy("at")) - 1).alias("type"), "name", "name2", "mass", "charge")  # a row per species
    atoms = raw.withColumn("name2", name2).join(types.select("type", "name2"), "name2").select("id", "vid", "atom", "name", "type", F.col("charge").cast("double").alias("q"), "m")
    bonds, angles = of("NBOND", "ij")[1], of("NTHETA", "ijk")[1]
    n, proper = of("NPHI", "ijkl")
    improper = of("NIMP", "ijkl")[1]
    dihedral = lambda df, start, pid, flag: df.select((F.col("r") + start).cast("long").alias("did"), *"ijkl", F.lit(pid).alias("pid"), F.lit(flag).alias("improper"))
    return Topology(
        atoms, types,
        bonds.select(F.col("r").cast("long").alias("bid"), "i", "j"),
        angles.select(F.col("r").cast("long").alias("aid"), "i", "j", "k", F.lit(-1).alias("pid")),
        dihedral(proper, 0, -1, False).union(dihedral(improper, n, -2, True)),
    )


def read_pdb(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """(n, name, x, y, z) of the n-th ATOM, in nm, wrapped into box. Records are ATOM, REMARK and END; another record
    is an error that names its line, raised when the rows are read."""
    rows = numbered(spark, path).select("line", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    kind = F.get(F.col("t"), F.lit(0))
    known = F.when(kind.isin("ATOM", "REMARK", "END"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown record "), kind, F.lit(" in line "), (F.col("line") + 1).cast("string"))))
    atoms = running(rows.select("line", "t", known.alias("k")).where("k = 'ATOM'"), "n", "line")
    at: list[Column] = [F.get(F.col("t"), F.lit(k)).cast("double") * 0.1 for k in (5, 6, 7)]
    if box:
        at = [wrap(u, o, d) for u, o, d in zip(at, box.origin, box.dim, strict=True)]
    return atoms.select(F.col("n").cast("long").alias("n"), F.get(F.col("t"), F.lit(2)).alias("name"), *[u.alias(c) for u, c in zip(at, "xyz", strict=True)])


def pdb_lines(ps: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(id, line): a fixed-width ATOM record per particle (id, name, vid, x, y, z), in Angstrom, without the species
    excluded. Columns are separated by blanks, so that the records can be read back whatever their numbers."""
    rows = ps.where(~F.col("name").isin(*excluded)) if excluded else ps
    at = [F.col(c) * 10.0 for c in "xyz"]
    line = F.format_string("ATOM  %5d %-4s X %4d %11.3f %11.3f %11.3f", (F.col("id") + 1) % 100000, "name", (F.col("vid") + 1) % 10000, *at)
    return rows.select("id", line.alias("line"))


def write_pdb(ps: DataFrame, path: str, excluded: tuple[str, ...] = ()) -> None:
    """Writes the records in order of id."""
    pdb_lines(ps, excluded).orderBy("id").select("line").write.text(path)


def psf_lines(ps: DataFrame, bonds: DataFrame, angles: DataFrame, dihedrals: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(section, at, line): a PSF that read_psf reads back. ps has id, vid, name, q and m; particles of the species
    excluded, and what is bonded to them, are left out. dihedrals tell impropers by their flag."""
    kept = ps.where(~F.col("name").isin(*excluded)) if excluded else ps
    gone = ps.where(F.col("name").isin(*excluded)).select("id") if excluded else None

    def whole(top: DataFrame, ends: str) -> DataFrame:
        if gone is not None:
            for e in ends:
                top = top.join(gone.withColumnRenamed("id", e), e, "left_anti")
        return top

    atom = F.format_string("%8d WAT %5d WAT %-4s %-4s %10.6f %13.5f %11d", F.col("id") + 1, F.col("vid") + 1, "name", "name", "q", "m", F.lit(0))
    numbers = lambda ends: F.concat_ws("", *[F.format_string("%8d", F.col(e) + 1) for e in ends])
    tables = [
        ("NATOM", kept.select(F.col("id").alias("at"), atom.alias("line"))),
        ("NBOND: bonds", whole(bonds, "ij").select(F.col("bid").alias("at"), numbers("ij").alias("line"))),
        ("NTHETA: angles", whole(angles, "ijk").select(F.col("aid").alias("at"), numbers("ijk").alias("line"))),
        ("NPHI: dihedrals", whole(dihedrals.where("not improper"), "ijkl").select(F.col("did").alias("at"), numbers("ijkl").alias("line"))),
        ("NIMPHI: impropers", whole(dihedrals.where("improper"), "ijkl").select(F.col("did").alias("at"), numbers("ijkl").alias("line"))),
    ]
    out = ps.sparkSession.createDataFrame([(0, -1, "PSF")], "section int, at long, line string")
    for k, (name, df) in enumerate(tables, 1):
        head = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("section"), F.lit(-1).cast("long").alias("at"), F.format_string(f"%8d !{name}", "n").alias("line"))
        out = out.union(head).union(df.select(F.lit(k).alias("section"), F.col("at").cast("long").alias("at"), "line"))
    return out


def write_psf(path: str, ps: DataFrame, bonds: DataFrame, angles: DataFrame, dihedrals: DataFrame, excluded: tuple[str, ...] = ()) -> None:
    """Writes the lines in order; a folder of parts, whose names give their order."""
    psf_lines(ps, bonds, angles, dihedrals, excluded).orderBy("section", "at").select("line").write.text(path)
