"""Queries on extensions, landscape profiles, variants and half-lives, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlens.operators import overlays
from shiftlens.plans.registry import _m, query
from shiftlens.sources.fixtures import points, read

_GENES = "genes AS (SELECT 'ACC' || p_partkey AS accession, 1 AS orf_start, 300 + 30 * p_size AS orf_stop FROM part)"
_EXTENDED = """extended AS (SELECT id, 100.0::DOUBLE * (start - orf_start) / (orf_stop - orf_start) AS percent, pairs * 7 / 3::DOUBLE AS codons,
  least(150.0::DOUBLE, 100.0::DOUBLE * (pairs * 7 + start - orf_start) / (orf_stop - orf_start)) AS percent_end,
  CASE WHEN mfe < avg_mfe AND zscore > avg_zscore THEN 'both' WHEN mfe < avg_mfe THEN 'energy' WHEN zscore > avg_zscore THEN 'z' ELSE 'neither' END AS quadrant
  FROM points JOIN genes USING (accession) JOIN (SELECT species, avg(mfe) AS avg_mfe, avg(zscore) AS avg_zscore FROM points GROUP BY species) USING (species))"""
_METHODS = ["method0", "method1", "method2"]
# Energies in whole cal/mol: their sums are the same in any order.
_LEAST = ", ".join(f"min(floor(mfe * 1000)) FILTER (WHERE mfe_method = '{m}') AS {m}" for m in _METHODS)
_MEANS = ", ".join(f"avg({m}) AS mean_{m}" for m in _METHODS)


def _genes(spark, d):
    return read(spark, d, "part").select(F.concat(F.lit("ACC"), "p_partkey").alias("accession"), F.lit(1).alias("orf_start"), (300 + 30 * F.col("p_size")).alias("orf_stop"))


def _extended(spark, d):
    return overlays.extensions(points(spark, d).withColumn("bp_mstop", F.col("pairs") * 7), _genes(spark, d))


@query("a16_extensions", _m("SELECT * FROM extended", _GENES, _EXTENDED))
def _(spark, d):
    return _extended(spark, d).select("id", "percent", "codons", "percent_end", "quadrant")


@query("a17_extension_histogram", _m("SELECT CAST(trunc(codons) AS INTEGER) AS codons, count(*) AS sites FROM extended GROUP BY trunc(codons)", _GENES, _EXTENDED))
def _(spark, d):
    return overlays.extension_histogram(_extended(spark, d))


@query("a17_frame_histogram", _m("SELECT CAST(trunc(percent) AS INTEGER) AS percent, count(*) AS sites, count(*) FILTER (WHERE codons > 30) AS long_sites, 100.0::DOUBLE * count(*) FILTER (WHERE codons > 30) / count(*) AS long_percent FROM extended GROUP BY trunc(percent)", _GENES, _EXTENDED))
def _(spark, d):
    return overlays.frame_histogram(_extended(spark, d))


@query("a18_landscape_profile", _m(f"""SELECT accession, start, {', '.join(_METHODS)}, {', '.join('mean_' + m for m in _METHODS)}, bool_or_site AS is_site, start BETWEEN orf_start AND orf_stop AS in_frame
FROM e JOIN means USING (accession) LEFT JOIN genes USING (accession)""", _GENES,
    f"e AS (SELECT accession, start, {_LEAST}, bool_or(knotp) AS bool_or_site FROM points GROUP BY accession, start)", f"means AS (SELECT accession, {_MEANS} FROM e GROUP BY accession)"))
def _(spark, d):
    p = points(spark, d).withColumn("mfe", F.floor(F.col("mfe") * 1000).cast("double"))
    return overlays.landscape_profile(p, p.where("knotp"), _genes(spark, d), _METHODS)


@query("j7_snp_counts", """WITH w AS (SELECT DISTINCT l_partkey % 200 AS gene, 1 + 3 * (l_orderkey % 300) AS start, 100 - 25 * (l_suppkey % 3) AS seqlength FROM lineitem), s AS (SELECT o_orderkey % 200 AS gene, 1 + o_custkey % 1000 AS spot FROM orders)
SELECT w.gene, start, seqlength, count(spot) AS snps FROM w LEFT JOIN s ON w.gene = s.gene AND spot BETWEEN start - 7 AND start + seqlength GROUP BY ALL""")
def _(spark, d):
    windows = read(spark, d, "lineitem").select((F.col("l_partkey") % 200).alias("gene"), (1 + 3 * (F.col("l_orderkey") % 300)).alias("start"), (100 - 25 * (F.col("l_suppkey") % 3)).alias("seqlength")).distinct()
    snps = read(spark, d, "orders").select((F.col("o_orderkey") % 200).alias("gene"), (1 + F.col("o_custkey") % 1000).alias("at"))
    return overlays.snp_counts(windows, snps)


@query("half_life_overlay", _m("""SELECT gene, half_life, accession, count(*) AS points, min(mfe) AS min_mfe
FROM (SELECT gene, half_life, min(accession) AS accession FROM lives JOIN names ON names.word = lower(gene) GROUP BY ALL) JOIN points USING (accession) GROUP BY ALL""",
    "lives AS (SELECT 'acc' || s_suppkey AS gene, s_acctbal / 100 AS half_life FROM supplier)",
    "names AS (SELECT 'ACC' || p_partkey AS accession, unnest(list_concat(['acc' || p_partkey], string_split_regex(lower(p_name || ' acc' || (p_partkey + 3)), '[^a-z0-9]+'))) AS word FROM part)"))
def _(spark, d):
    lives = read(spark, d, "supplier").select(F.concat(F.lit("acc"), "s_suppkey").alias("gene"), (F.col("s_acctbal") / 100).alias("half_life"))
    names = read(spark, d, "part").select(F.concat(F.lit("ACC"), "p_partkey").alias("accession"), F.concat("p_name", F.lit(" acc"), F.col("p_partkey") + 3).alias("words"))
    found = overlays.half_life_overlay(lives, names, points(spark, d))
    return found.groupBy("gene", "half_life", "accession").agg(F.count("*").alias("points"), F.min("mfe").alias("min_mfe"))
