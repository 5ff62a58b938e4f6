"""Data laid over predictions: extensions behind a shift, landscape profiles, variants and half-lives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.operators.stats import binned_range_join

#: Extensions end at this percentage of the frame; those of more codons than LONG count as long.
MOST, LONG = 150.0, 30


def extensions(points: DataFrame, genes: DataFrame) -> DataFrame:
    """Where in its frame each site lies (percent), how far the shifted frame runs on (codons, and its end as a percentage up to
    MOST), and its quadrant by the species' mean energy and z: both, energy, z or neither. A frame of no length has null percentages."""
    means = points.groupBy("species").agg(F.avg("mfe").alias("avg_mfe"), F.avg("zscore").alias("avg_zscore"))
    length = F.nullif(F.col("orf_stop") - F.col("orf_start"), F.lit(0))
    low, high = F.col("mfe") < F.col("avg_mfe"), F.col("zscore") > F.col("avg_zscore")
    return (
        points.join(genes.select("accession", "orf_start", "orf_stop"), "accession").join(means, "species")
        .withColumn("percent", 100.0 * (F.col("start") - F.col("orf_start")) / length)
        .withColumn("codons", F.col("bp_mstop") / 3)
        .withColumn("percent_end", F.least(F.lit(MOST), 100.0 * (F.col("bp_mstop") + F.col("start") - F.col("orf_start")) / length))
        .withColumn("quadrant", F.when(low & high, "both").when(low, "energy").when(high, "z").otherwise("neither"))
        .drop("avg_mfe", "avg_zscore")
    )


def extension_histogram(extended: DataFrame) -> DataFrame:
    """Sites for each whole number of codons."""
    return extended.groupBy(F.col("codons").cast("int").alias("codons")).agg(F.count("*").alias("sites"))


def frame_histogram(extended: DataFrame) -> DataFrame:
    """Sites, sites with long extensions, and the share of these, for each whole percent of the frame."""
    long = F.count_if(F.col("codons") > LONG)
    counted = extended.groupBy(F.col("percent").cast("int").alias("percent")).agg(F.count("*").alias("sites"), long.alias("long_sites"))
    return counted.withColumn("long_percent", 100.0 * F.col("long_sites") / F.col("sites"))


def landscape_profile(landscape: DataFrame, sites: DataFrame, genes: DataFrame, methods: list[str]) -> DataFrame:
    """For each place of each sequence the least energy by each method, each method's mean over the sequence, whether a site starts
    there, and whether the place lies in the frame. Means are partial sums joined back, so no sequence is held by one task."""
    energies = landscape.groupBy("accession", "start").agg(*[F.min(F.when(F.col("mfe_method") == m, F.col("mfe"))).alias(m) for m in methods])
    means = energies.groupBy("accession").agg(*[F.avg(m).alias(f"mean_{m}") for m in methods])
    marks = sites.select("accession", "start").distinct().withColumn("is_site", F.lit(True))
    return (
        energies.join(marks, ["accession", "start"], "left").join(means, "accession").join(genes.select("accession", "orf_start", "orf_stop"), "accession", "left")
        .select("accession", "start", *methods, *[f"mean_{m}" for m in methods], F.coalesce("is_site", F.lit(False)).alias("is_site"), F.col("start").between(F.col("orf_start"), F.col("orf_stop")).alias("in_frame"))
    )


def snp_counts(windows: DataFrame, snps: DataFrame, before: int = 7, bin_size: int = 128) -> DataFrame:
    """Variants (gene, at) from `before` bases ahead of each window (gene, start, seqlength) to its end; windows without any count 0."""
    keys = ["gene", "start", "seqlength"]
    spans = windows.select(*keys, (F.col("start") - before - 1).alias("lo"), (F.col("start") + F.col("seqlength") + 1).alias("hi"))
    hits = binned_range_join(snps.select("gene", "at", F.col("at").alias("at_end")), spans, "gene", bin_size)
    counted = hits.groupBy(*keys).agg(F.count("*").alias("found"))
    return windows.select(*keys).join(counted, keys, "left").select(*keys, F.coalesce("found", F.lit(0)).alias("snps"))


def half_life_overlay(half_lives: DataFrame, names: DataFrame, points: DataFrame) -> DataFrame:
    """Predictions of the sequence that each gene (gene, half_life) names: the least accession whose own name or words
    (accession, words) hold the gene as a whole word. Matching by words makes it an equi-join."""
    words = F.array_distinct(F.concat(F.array(F.lower("accession")), F.filter(F.split(F.lower("words"), "[^a-z0-9]+"), lambda w: w != "")))
    known = names.select("accession", F.explode(words).alias("word"))
    matched = half_lives.withColumn("word", F.lower("gene")).join(known, "word").groupBy("gene", "half_life").agg(F.min("accession").alias("accession"))
    return matched.join(points, "accession")
