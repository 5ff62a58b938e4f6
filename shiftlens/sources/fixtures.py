"""Domain tables derived from the given ones, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENOME_SQL = """genome AS (SELECT doc_id AS id, 'ACC' || doc_id AS accession, lang AS species, source AS genename, text AS comment,
  translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTAACTTGCTGATCAGTCATGCAT') AS mrna_seq FROM documents)"""
SITES_SQL = """sites AS (SELECT id, accession, species, mrna_seq, CAST(p AS INTEGER) AS start, substr(mrna_seq, p, 7) AS slipsite
  FROM genome, generate_series(3, length(mrna_seq) - 7, 3) AS t(p) WHERE regexp_matches(substr(mrna_seq, p, 7), '^(AAA|CCC|GGG|TTT)(AAA|TTT)[ACGT]$'))"""
MFE_SQL = """mfe AS (SELECT CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT))), 1, 15) AS BIGINT) AS id,
  l_partkey AS genome_id, 'ACC' || l_partkey AS accession, 'sp' || (l_partkey % 5) AS species, 'method' || (l_linenumber % 3) AS mfe_method,
  CAST(100 - 25 * (l_suppkey % 3) AS INTEGER) AS seqlength, CAST(1 + 3 * (l_orderkey % 300) AS INTEGER) AS start,
  -(l_extendedprice / 1500.0) AS mfe, CAST(l_quantity AS INTEGER) AS pairs, l_returnflag = 'R' AS knotp,
  -(l_extendedprice / 1500.0) + (l_discount - 0.05) * 100 AS mfe_mean, 1 + l_tax * 50 AS mfe_sd FROM lineitem)"""
POINTS_SQL = """points AS (SELECT *, (mfe - mfe_mean) / mfe_sd AS zscore FROM mfe)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    seq = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTAACTTGCTGATCAGTCATGCAT")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("ACC"), "doc_id").alias("accession"), F.col("lang").alias("species"), F.col("source").alias("genename"),
        F.col("text").alias("comment"), seq.alias("mrna_seq"), F.lit(1).alias("orf_start"), F.length(seq).alias("orf_stop"),
    )


def mfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their null-model mean and deviation. Ids are hashes of a row's keys, so nothing is sorted; equal rows share one."""
    digest = F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long")))
    energy = -(F.col("l_extendedprice") / 1500.0)
    return read(spark, sf_dir, "lineitem").select(
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("id"), F.col("l_partkey").alias("genome_id"), F.concat(F.lit("ACC"), "l_partkey").alias("accession"),
        F.concat(F.lit("sp"), F.col("l_partkey") % 5).alias("species"), F.concat(F.lit("method"), F.col("l_linenumber") % 3).alias("mfe_method"),
        (100 - 25 * (F.col("l_suppkey") % 3)).cast("int").alias("seqlength"), (1 + 3 * (F.col("l_orderkey") % 300)).cast("int").alias("start"),
        energy.alias("mfe"), F.col("l_quantity").cast("int").alias("pairs"), (F.col("l_returnflag") == "R").alias("knotp"),
        (energy + (F.col("l_discount") - 0.05) * 100).alias("mfe_mean"), (1 + F.col("l_tax") * 50).alias("mfe_sd"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mfe(spark, sf_dir).withColumn("zscore", (F.col("mfe") - F.col("mfe_mean")) / F.col("mfe_sd"))
