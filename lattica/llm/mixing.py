"""Mixing sources to target weights.

Tokens are summed per source, targets are filled up by weight below a cap, and each document is emitted floor(rate)
times plus one Bernoulli copy, drawn from a hash of seed and doc_id, with the fraction of the rate as probability.

A draw's error in a source's total is a matter of luck, so DRAWS seeds are tried in one aggregation and each source
keeps the one that comes nearest to its target. Everything is a function of the rows, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null doc_id draws as the
text "null"; rows that repeat a doc_id draw alike; a source of size 0 has target 0 and its documents are not emitted;
no rows give no rows. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import word_count, written
from lattica.operators.state import running

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, DRAWS, SEED = 1.5, 2.0, 32, 17


def draw(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """Uniform in [0, 1) from the first 52 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}:{k}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16**13)


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), a row per source.

    A source's cap binds below the level cap * size / weight; in order of that level the capped ones are a prefix, and
    the rest share what the prefix leaves by weight. Places and sums in that order run range by range, so sources may be
    as many as hosts.
    """
    by_name = F.col("source").asc_nulls_last()
    ranked = running(sources.select("source", "source_size"), "n", by_name)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("n"), F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("level", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    ranked = running(ranked, {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, "level", by_name)
    ranked = written(ranked, "mix-levels")
    total = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    fill = (F.lit(float(share) * float(total["s"] or 0)) - F.lit(float(cap)) * F.col("size_before")) / (F.lit(float(total["w"] or 0)) - F.col("weight_before"))
    water = ranked.select("level", fill.alias("fill")).where("fill <= level").agg(F.max("fill")).first()[0]  # the highest is the first that fits
    top = F.lit(float(cap)) * F.col("source_size")
    target = top if water is None else F.least(top, F.lit(water) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """From (doc_id, source, size): one row per source with source_size, target, rate and the chosen draw."""
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rated = targets(sums, weights, share, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rated = written(rated, "mix-targets")  # one row per source; its measured size lets Spark choose the join
    tried = _with_source(sized.groupBy("source", "doc_id").agg(F.sum("size").alias("size")), rated)
    taken = tried.groupBy("source").agg(F.first("target").alias("t"), *[F.sum(F.col("size") * copies(F.col("rate"), draw(F.col("doc_id"), k, seed))).alias(f"d{k}") for k in range(draws)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"d{k}") - F.col("t")).alias("off"), F.lit(k).alias("k")) for k in range(draws)]))["k"]
    return written(_with_source(taken.select("source", best.alias("draw")), rated), "mix-plan")


def _with_source(left: DataFrame, per_source: DataFrame) -> DataFrame:
    """Null-safe join on source. No hint: Spark broadcasts the small side after measuring it, else sorts and splits."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    right = per_source.select(key(F.col("source")).alias("_mix_key"), *[c for c in per_source.columns if c != "source"])
    return left.withColumn("_mix_key", key(F.col("source"))).join(right, "_mix_key").drop("_mix_key")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) per row of docs."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    rows = _with_source(sized, plan(sized, weights, share, cap, draws, seed))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _chosen(draws, seed)).alias("taken"), _chosen(draws, seed).alias("copies"))


def _chosen(draws: int, seed: int) -> Column:
    """Copies under the source's chosen draw."""
    key = F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    u = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16**13)
    return copies(F.col("rate"), u)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """docs with each row emitted as often as the mix takes it; the columns of docs."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    chosen = plan(sized, weights, share, cap, draws, seed).select("source", "rate", "draw")
    n = _with_source(docs.select(F.struct("*").alias("_row"), "doc_id", "source"), chosen).withColumn("_n", _chosen(draws, seed))
    return n.where("_n > 0").select(F.explode(F.array_repeat("_row", F.col("_n").cast("int"))).alias("_row")).select("_row.*")


def _sql_copies(rate: str, draw_sql: str) -> str:
    u = f"(('0x' || substr(md5('{SEED}:' || {draw_sql} || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(16**13)})"
    return f"(floor({rate})::BIGINT + (({u}) < {rate} - floor({rate}))::BIGINT)"


#: The same with an iterated water level: the recursion caps what is above its target until none is.
SQL = f"""
WITH RECURSIVE s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, [{", ".join(f"{w!r}::DOUBLE" for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight FROM s GROUP BY source),
fill AS (
    SELECT 0 AS step, ({SHARE}::DOUBLE * sum(source_size)) / sum(weight) AS level FROM src
    UNION ALL
    SELECT step + 1, (SELECT ({SHARE}::DOUBLE * sum(source_size) - {CAP}::DOUBLE * coalesce(sum(source_size) FILTER (WHERE {CAP}::DOUBLE * source_size / weight < level), 0)) / sum(weight) FILTER (WHERE {CAP}::DOUBLE * source_size / weight >= level) FROM src) FROM fill
    WHERE step < 200 AND level IS NOT NULL),
lv AS (SELECT max(level) AS level FROM fill),
tg AS (SELECT source, source_size, CASE WHEN level IS NULL OR {CAP}::DOUBLE * source_size / weight < level THEN {CAP}::DOUBLE * source_size ELSE level * weight END AS target FROM src, lv),
rt AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM tg),
j AS (SELECT s.doc_id, s.source, s.size, rt.source_size, rt.target, rt.rate FROM s JOIN rt ON s.source IS NOT DISTINCT FROM rt.source),
tr AS (SELECT source, k, abs(sum(size * {_sql_copies("rate", "k::VARCHAR")}) - first(target)) AS off FROM j, range({DRAWS}) AS t(k) GROUP BY source, k),
best AS (SELECT source, arg_min(k, off * 1e6 + k * 1e-9) AS k FROM tr GROUP BY source)
SELECT j.doc_id, j.size, j.source_size, j.target, j.size * {_sql_copies("j.rate", "best.k::VARCHAR")} AS taken, {_sql_copies("j.rate", "best.k::VARCHAR")} AS copies
FROM j JOIN best ON j.source IS NOT DISTINCT FROM best.source
"""
