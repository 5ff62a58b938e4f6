"""Queries on predictions joined with null models, genes and variants, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import points as P
from shiftlens.operators import stats
from shiftlens.plans.registry import _CODONS_SQL, ORACLES, _g, _m, query
from shiftlens.sources.fixtures import SITES_SQL, mfe, read

HEPTAMERS = [3 * a + 3 * b + c for a in "ACGT" for b in "AT" for c in "ACGT"]
_SLIP = "[" + ", ".join(f"'{h}'" for h in HEPTAMERS) + "]"

_PREDICTIONS = f"""predictions AS (SELECT id, accession, species, mfe_method, seqlength, start, mfe, pairs, knotp, mfe_mean, mfe_sd,
  ({_SLIP})[1 + genome_id % 32] AS slipsite FROM mfe)"""
_GENES = """genes AS (SELECT 'ACC' || p_partkey AS accession, 'sp' || (p_partkey % 5) AS species, p_name AS genename, p_brand AS comment,
  1 AS orf_start, 300 + 30 * p_size AS orf_stop FROM part)"""
_BOOT = "boot AS (SELECT DISTINCT id AS mfe_id, mfe, mfe_mean, mfe_sd FROM predictions WHERE id % 10 <> 0)"
_CLOUD = """scored AS (SELECT mfe_id, round(coalesce((mfe - mfe_mean) / mfe_sd, 0), 3) AS zscore FROM boot WHERE mfe <= 10),
cloud AS (SELECT p.*, zscore, genename, orf_start, orf_stop FROM predictions p JOIN scored ON p.id = mfe_id JOIN (SELECT accession, genename, orf_start, orf_stop FROM genes) USING (accession)
  WHERE mfe > -80 AND mfe < 5 AND zscore > -10 AND zscore < 10)"""
_ALL = [_PREDICTIONS, _GENES, _BOOT, _CLOUD]
_SNPS = """snps AS (SELECT o_orderkey AS snp_id, 'ACC' || (o_orderkey % 2000 + 1) AS accession, 1 + o_custkey % 1000 AS lo,
  1 + o_custkey % 1000 + CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 9 ELSE 0 END AS hi FROM orders)"""
_CLASSES = """stems AS (SELECT *, list_transform(range(seqlength), lambda i: CASE WHEN (i + start) % 9 < 4 THEN CAST((i // 9) % 4 + 1 AS INTEGER) END) AS parsed FROM predictions),
met AS (SELECT snp_id, p.id AS mfe_id, lo, hi, start, parsed, seqlength FROM snps s JOIN stems p ON s.accession = p.accession AND lo <= start + 6 + seqlength AND hi >= start),
classes AS (SELECT DISTINCT snp_id, mfe_id, CASE WHEN lo <= start + 6 THEN 's'
  ELSE coalesce(CAST(list_min(list_filter(parsed[lo - start - 6 : least(hi, start + 6 + seqlength) - start - 6], lambda x: x IS NOT NULL)) AS VARCHAR), 'f') END AS class FROM met)"""


def _predictions(spark, d):
    table = F.array(*[F.lit(h) for h in HEPTAMERS])
    return mfe(spark, d).withColumn("slipsite", F.get(table, (F.col("genome_id") % 32).cast("int")))


def _genes(spark, d):
    key = F.col("p_partkey")
    return read(spark, d, "part").select(
        F.concat(F.lit("ACC"), key).alias("accession"), F.concat(F.lit("sp"), key % 5).alias("species"), F.col("p_name").alias("genename"), F.col("p_brand").alias("comment"),
        F.lit(1).alias("orf_start"), (300 + 30 * F.col("p_size")).alias("orf_stop"),
    )


def _boot(spark, d):
    return _predictions(spark, d).where("id % 10 <> 0").select(F.col("id").alias("mfe_id"), "mfe_mean", "mfe_sd").distinct()


def _cloud(spark, d, **how):
    return P.cloud_points(_predictions(spark, d).drop("mfe_mean", "mfe_sd"), _boot(spark, d), _genes(spark, d), **how)


def _snps(spark, d):
    at = 1 + F.col("o_custkey") % 1000
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("snp_id"), F.concat(F.lit("ACC"), F.col("o_orderkey") % 2000 + 1).alias("accession"), at.alias("lo"),
        (at + F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") % 9).otherwise(0)).alias("hi"),
    )


def _classes(spark, d):
    stem = lambda i: F.when((i + F.col("start")) % 9 < 4, (F.floor(i / 9) % 4 + 1).cast("int"))
    windows = _predictions(spark, d).withColumn("parsed", F.transform(F.sequence(F.lit(0), F.col("seqlength") - 1), stem))
    return P.snp_classes(windows, _snps(spark, d))


@query("j1_cloud_points", _m("SELECT id, accession, genename, species, seqlength, mfe_method, start, slipsite, knotp, round(mfe, 4) AS mfe, zscore FROM cloud", *_ALL))
def _(spark, d):
    return _cloud(spark, d).select("id", "accession", "genename", "species", "seqlength", "mfe_method", "start", "slipsite", "knotp", F.round("mfe", 4).alias("mfe"), "zscore")


@query("f2_f3_knotted_points", _m("SELECT species, count(*) AS n FROM cloud WHERE knotp AND mfe_method IN ('method0', 'method2') GROUP BY species", *_ALL))
def _(spark, d):
    return _cloud(spark, d, methods=["method0", "method2"], knots_only=True).groupBy("species").agg(F.count("*").alias("n"))


@query("a12_energy_bins", _m("""SELECT bin, series, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(CAST(floor((hi - lo) / 0.3::DOUBLE) AS BIGINT) + 1)) AS INTEGER) AS bin FROM ends) b CROSS JOIN (SELECT DISTINCT knotp AS series FROM cloud) s
LEFT JOIN (SELECT CAST(floor((mfe - lo) / 0.3::DOUBLE) AS INTEGER) AS bin, knotp AS series, count(*) AS n FROM cloud, ends GROUP BY ALL) USING (bin, series)""", *_ALL, "ends AS (SELECT min(mfe) - 3 AS lo, max(mfe) + 3 AS hi FROM cloud)"))
def _(spark, d):
    return P.axis_distribution(_cloud(spark, d), "mfe", 0.3, 3.0, F.col("knotp"))


@query("a13_z_by_family", _m("""SELECT bin, series, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(CAST(floor((hi - lo) / 0.1::DOUBLE) AS BIGINT) + 1)) AS INTEGER) AS bin FROM ends) b CROSS JOIN (SELECT DISTINCT translate(substr(slipsite, 1, 3), 'T', 'U') AS series FROM cloud) s
LEFT JOIN (SELECT CAST(floor((zscore - lo) / 0.1::DOUBLE) AS INTEGER) AS bin, translate(substr(slipsite, 1, 3), 'T', 'U') AS series, count(*) AS n FROM cloud, ends GROUP BY ALL) USING (bin, series)""", *_ALL, "ends AS (SELECT min(zscore) - 0 AS lo, max(zscore) + 0 AS hi FROM cloud)"))
def _(spark, d):
    return P.axis_distribution(_cloud(spark, d), "zscore", 0.1, 0.0, P.slipsite_family(F.col("slipsite")))


_LOW = "mfe <= am - sm AND zscore <= az - sz"


@query("a14_slipsite_bars", _m(f"""SELECT slipsite, count(*) AS total, count(*) FILTER (WHERE {_LOW}) AS significant, round(100.0 * count(*) FILTER (WHERE {_LOW}) / count(*), 2) AS percent
FROM cloud JOIN (SELECT species, avg(mfe) AS am, stddev_pop(mfe) AS sm, avg(zscore) AS az, stddev_pop(zscore) AS sz FROM cloud GROUP BY species) USING (species) GROUP BY slipsite""", *_ALL))
def _(spark, d):
    return stats.significant_by(_cloud(spark, d), "slipsite")


def _beyond(k: int) -> str:
    w = "(PARTITION BY species, seqlength, mfe_method)"
    return f"(mfe < avg(mfe) OVER {w} - {k} * stddev_pop(mfe) OVER {w} AND zscore < avg(zscore) OVER {w} - {k} * stddev_pop(zscore) OVER {w})"


_MARKED = f"marked AS (SELECT *, {_beyond(1)} AS one, {_beyond(2)} AS two FROM cloud)"


@query("a3_species_summary", _m("""SELECT g.species, orfs, coalesce(folds, 0) AS folds, coalesce(significant, 0) AS significant FROM (SELECT species, count(*) AS orfs FROM genes GROUP BY species) g
LEFT JOIN (SELECT species, count(*) AS folds, count(*) FILTER (WHERE one) AS significant FROM marked WHERE seqlength = 100 GROUP BY species) USING (species)""", *_ALL, _MARKED))
def _(spark, d):
    return P.species_summary(_genes(spark, d), _cloud(spark, d))


@query("a7_significant_counts", _m("""SELECT mfe_method, count(*) AS n, count(*) FILTER (WHERE one) AS at_1, count(*) FILTER (WHERE one AND knotp) AS at_1_knotted,
count(*) FILTER (WHERE two) AS at_2, count(*) FILTER (WHERE two AND knotp) AS at_2_knotted FROM marked GROUP BY mfe_method""", *_ALL, _MARKED))
def _(spark, d):
    return P.significant_counts(_cloud(spark, d))


@query("a15_summary_pie", _m("""SELECT species, count(*) FILTER (WHERE hit IS NULL) AS no_match, count(*) FILTER (WHERE NOT hit) AS insignificant, count(*) FILTER (WHERE hit) AS significant
FROM genes LEFT JOIN (SELECT accession, bool_or(one) AS hit FROM marked GROUP BY accession) USING (accession) GROUP BY species""", *_ALL, _MARKED))
def _(spark, d):
    return P.summary_pie(_genes(spark, d), _cloud(spark, d))


@query("a6_heptamer_count", _m("SELECT species, slipsite, count(DISTINCT (accession, start)) AS sites FROM predictions GROUP BY ALL", *_ALL))
def _(spark, d):
    return P.heptamer_count(_predictions(spark, d))


@query("a5_folds_per_site", _m("""SELECT accession, start, slipsite, count(*) AS folds, CAST(sum(count(*)) OVER (PARTITION BY accession) AS BIGINT) AS total
FROM predictions JOIN (SELECT accession, orf_stop FROM genes) USING (accession) WHERE start < orf_stop GROUP BY accession, start, slipsite""", *_ALL))
def _(spark, d):
    return P.folds_per_site(_predictions(spark, d), _genes(spark, d))


@query("j3_detail", _m("SELECT id, accession, start, seqlength, mfe_method, genename, orf_stop FROM predictions LEFT JOIN (SELECT accession, genename, orf_stop FROM genes) USING (accession)", *_ALL))
def _(spark, d):
    return P.detail(_predictions(spark, d), _genes(spark, d)).select("id", "accession", "start", "seqlength", "mfe_method", "genename", "orf_stop")


@query("j16_gene_bundle", _m("""SELECT accession, genename, coalesce(sites, 0) AS sites, coalesce(folds, 0) AS folds, coalesce(variants, 0) AS variants FROM genes
LEFT JOIN (SELECT accession, count(DISTINCT start) AS sites, count(*) AS folds FROM predictions GROUP BY accession) USING (accession)
LEFT JOIN (SELECT accession, count(*) AS variants FROM snps GROUP BY accession) USING (accession)""", *_ALL, _SNPS))
def _(spark, d):
    return P.gene_bundle(_genes(spark, d), _predictions(spark, d), _snps(spark, d))


@query("j6_snp_classes", _m("SELECT snp_id, mfe_id, class FROM classes", *_ALL, _SNPS, _CLASSES))
def _(spark, d):
    return _classes(spark, d)


@query("u5_snp_summary", _m("""SELECT snp_id, coalesce(frameshift, 'n') AS frameshift, coalesce(n, 0) AS n FROM snps LEFT JOIN (SELECT snp_id,
arg_min(class, CASE class WHEN 's' THEN -1 WHEN 'f' THEN 1000000 ELSE CAST(class AS INTEGER) END) AS frameshift, count(DISTINCT mfe_id) AS n FROM classes GROUP BY snp_id) USING (snp_id)""".replace("CASE class WHEN 's' THEN -1 WHEN 'f' THEN 1000000 ELSE CAST(class AS INTEGER) END", "CASE class WHEN 's' THEN -1 WHEN 'f' THEN 1000000 ELSE TRY_CAST(class AS INTEGER) END"), *_ALL, _SNPS, _CLASSES))
def _(spark, d):
    return P.snp_summary(_snps(spark, d), _classes(spark, d)).select("snp_id", "frameshift", F.size("mfe_ids").cast("long").alias("n"))


@query("u5_has_snp", _m("SELECT id, bool_or(id IN (SELECT mfe_id FROM classes)) AS has_snp FROM predictions GROUP BY id", *_ALL, _SNPS, _CLASSES))
def _(spark, d):
    return P.has_snp(_predictions(spark, d), _classes(spark, d)).groupBy("id").agg(F.bool_or("has_snp").alias("has_snp"))


@query("f7_stem_variants", _m("SELECT class, count(*) AS n FROM classes WHERE regexp_matches(class, '^[0-9]+$') OR class = 's' GROUP BY class", *_ALL, _SNPS, _CLASSES))
def _(spark, d):
    return P.of_class(_classes(spark, d), "sd").groupBy("class").agg(F.count("*").alias("n"))


@query("j11_at_coordinates", _m("""SELECT id, accession FROM cloud WHERE (round(mfe * 100), round(zscore * 10)) IN (SELECT (round(mfe * 100), round(zscore * 10)) FROM cloud WHERE knotp AND slipsite = 'AAAAAAA')""", *_ALL))
def _(spark, d):
    cloud = _cloud(spark, d)
    wanted = cloud.where("knotp and slipsite = 'AAAAAAA'").select(F.round(F.col("mfe") * 100).cast("long").alias("mfe100"), F.round(F.col("zscore") * 10).cast("long").alias("z10"))
    return P.at_coordinates(cloud, wanted).select("id", "accession")


@query("j15_known_signals", _m("""SELECT accession, position, start FROM (SELECT DISTINCT 'ACC' || c_custkey AS accession, 1 + c_custkey % 900 AS position FROM customer) k
LEFT JOIN (SELECT DISTINCT accession, start FROM predictions) p USING (accession) WHERE abs(start - position) <= 3
UNION ALL SELECT accession, position, -1 FROM (SELECT DISTINCT 'ACC' || c_custkey AS accession, 1 + c_custkey % 900 AS position FROM customer) k
WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.accession = k.accession AND abs(p.start - k.position) <= 3)""", *_ALL))
def _(spark, d):
    signals = read(spark, d, "customer").select(F.concat(F.lit("ACC"), "c_custkey").alias("accession"), (1 + F.col("c_custkey") % 900).alias("position"))
    return P.known_signals(signals, _predictions(spark, d)).withColumn("start", F.coalesce("start", F.lit(-1)))


@query("u3_backfill", _m("SELECT b.mfe_id, min(coalesce(CASE WHEN mfe_id % 3 = 0 THEN NULL ELSE p.seqlength END, p.seqlength)) AS seqlength FROM boot b JOIN predictions p ON p.id = b.mfe_id GROUP BY b.mfe_id", *_ALL))
def _(spark, d):
    m = _predictions(spark, d)
    lost = _boot(spark, d).join(m.select(F.col("id").alias("mfe_id"), "seqlength").distinct(), "mfe_id").withColumn("seqlength", F.when(F.col("mfe_id") % 3 != 0, F.col("seqlength")))
    return P.backfill(lost, m, ["seqlength"]).groupBy("mfe_id").agg(F.min("seqlength").alias("seqlength"))


@query("w4_without_repeats", _m("""SELECT accession, start, mfe_method FROM (SELECT *, lag(start) OVER w AS before FROM (SELECT DISTINCT accession, start, mfe_method FROM predictions) WINDOW w AS (PARTITION BY accession ORDER BY start, mfe_method))
WHERE before IS NULL OR before <> start""", *_ALL))
def _(spark, d):
    rows = _predictions(spark, d).select("accession", "start", "mfe_method").distinct()
    return P.without_repeats(rows, "accession", ["start", "mfe_method"], ["accession", "start"])


@query("w7_pick_one", "SELECT p_partkey FROM part ORDER BY md5('7|' || p_partkey), p_partkey LIMIT 1")
def _(spark, d):
    return P.pick_one(read(spark, d, "part").select("p_partkey"), "p_partkey", 7)


@query("p12_length_class", _g("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN length(w) IS NULL OR length(w) = 0 THEN 'null' WHEN length(w) < 100 THEN 'shorter' WHEN length(w) = 100 THEN 'equal' ELSE 'longer' END AS class
FROM (SELECT substr(mrna_seq, start + 7, 100) AS w FROM sites)) GROUP BY class""", SITES_SQL))
def _(spark, d):
    from shiftlens.operators.scan import find_slipsites
    from shiftlens.sources.fixtures import genome

    return find_slipsites(genome(spark, d), (100,)).groupBy(P.window_length_class(F.col("sequence"), F.col("seqlength")).alias("class")).agg(F.count("*").alias("n"))


@query("p10_fix_slipsites", _m("SELECT translate(slipsite, 'T', 'U') AS slipsite, count(*) AS n FROM predictions GROUP BY 1", *_ALL))
def _(spark, d):
    return P.fix_slipsites(_predictions(spark, d)).groupBy("slipsite").agg(F.count("*").alias("n"))


@query("f6_gene_pattern", _m("SELECT accession FROM genes WHERE regexp_matches(accession, '1[0-9]*7$') OR regexp_matches(genename, '1[0-9]*7$') OR regexp_matches(comment, '1[0-9]*7$')", *_ALL))
def _(spark, d):
    return P.gene_search(_genes(spark, d), pattern="1[0-9]*7$").select("accession")


@query("f4_gene_exact", _m("SELECT accession, orf_stop FROM genes WHERE accession = 'ACC17' OR genename = 'ACC17'", *_ALL))
def _(spark, d):
    return P.gene_search(_genes(spark, d), exact="ACC17").select("accession", "orf_stop")


@query("s13_criteria", _m("SELECT id, accession FROM predictions WHERE mfe_method = 'method1' AND mfe < -60 AND seqlength = 75", *_ALL))
def _(spark, d):
    return P.criteria_select(_predictions(spark, d), ["id", "accession"], {"mfe_method": "method1", "mfe": ("<", -60), "seqlength": 75})


@query("k12_drop_accessions", _m("SELECT accession, count(*) AS n FROM predictions WHERE accession NOT IN (SELECT accession FROM genes WHERE comment = 'Brand#11') GROUP BY accession", *_ALL))
def _(spark, d):
    gone = _genes(spark, d).where("comment = 'Brand#11'")
    return P.drop_accessions({"mfe": _predictions(spark, d)}, gone)["mfe"].groupBy("accession").agg(F.count("*").alias("n"))


ORACLES["p17_minus_track"] = _g("SELECT id, rpad(coalesce(t, ''), CAST(length(mrna_seq) AS INTEGER), '.') AS track FROM genome LEFT JOIN (SELECT id, string_agg(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN codon ELSE '...' END, '' ORDER BY k) AS t FROM cd WHERE frame = 2 GROUP BY id) USING (id)", _CODONS_SQL % "mrna_seq")
ORACLES["r8_drawn_doublets"] = _g("""SELECT id, start, iteration, string_agg(o[CAST('0x' || substr(md5('7|' || id || '|' || start || '|' || iteration || '|' || i), 1, 7) AS BIGINT) % len(o) + 1], '' ORDER BY i) AS shuffled
FROM (SELECT id, start, regexp_extract_all(substr(mrna_seq, start + 7, 50), '.{2}') AS o FROM sites WHERE length(mrna_seq) >= start + 56), (SELECT CAST(unnest(range(25)) AS INTEGER) AS i), (SELECT CAST(unnest(generate_series(1, 10)) AS INTEGER) AS iteration) GROUP BY ALL""", SITES_SQL)
