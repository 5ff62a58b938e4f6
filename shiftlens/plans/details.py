"""Queries on record locations, connect tables, compositions, columns, cells, lookups and related rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import points as P
from shiftlens.operators import scan, signals, structure
from shiftlens.plans.joins import _GENES, _PREDICTIONS, _genes, _predictions
from shiftlens.plans.motifs import _BRACKETS, _EDGES, _STEMS, METHODS, _behind, _tracks
from shiftlens.plans.registry import _CODON_MAP, _OPEN, _g, _m, query
from shiftlens.sources import readers
from shiftlens.sources.fixtures import SITES_SQL, genome, points, read
from shiftlens.sources.work import work_dir

#: Locations by id modulo 4, of a sequence of 90 bases or more.
_PLACES = ("11..40", "complement(21..50)", "join(11..20,31..45)", "complement(join(12..20,<31..45,61..>70))")


def _records(spark, d):
    """GenBank records of the transcripts: the location broken over two lines, a qualifier behind it, and the bases in lines of 60."""
    place = F.element_at(F.array(*[F.lit(p.replace(",", ",\n" + 21 * " ")) for p in _PLACES]), (F.col("id") % 4 + 1).cast("int"))
    bases = F.regexp_replace(F.regexp_replace(F.lower("mrna_seq"), "(.{60})", "$1\n        1 "), "(.{10})", "$1 ")
    parts = [
        F.lit("LOCUS       "), "accession", F.lit("\nACCESSION   "), "accession", F.lit("\nFEATURES             Location/Qualifiers\n     source          1..90\n     CDS             "),
        place, F.lit('\n                     /gene="'), "genename", F.lit('"\n                     /codon_start='), (F.col("id") % 3 + 1).cast("string"), F.lit("\nORIGIN\n        1 "), bases, F.lit("\n//"),
    ]
    return genome(spark, d).where(F.length("mrna_seq") >= 90).select(F.concat(*parts).alias("value"))


_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"


@query(
    "s2_genbank_locations",
    _g(
        f"""SELECT accession || '-' || CASE kind WHEN 0 THEN 11 WHEN 1 THEN 21 WHEN 2 THEN 11 ELSE 12 END AS accession, genename AS gene, CASE WHEN kind % 2 = 0 THEN 'forward' ELSE 'reverse' END AS direction,
CASE kind WHEN 0 THEN substr(s, 1, 70) WHEN 1 THEN {_RC.format("substr(s, 1, 80)")} WHEN 2 THEN substr(s, 1, 20) || substr(s, 31, 45)
  ELSE {_RC.format("substr(s, 1, 20) || substr(s, 31, 15) || substr(s, 61, 40)")} END AS mrna_seq,
CAST(id % 3 + CASE kind WHEN 0 THEN 11 WHEN 1 THEN 31 WHEN 2 THEN 11 ELSE 1 + least(30, length(s) - 70) END AS INTEGER) AS orf_start,
CAST(CASE kind WHEN 0 THEN 40 WHEN 1 THEN 60 WHEN 2 THEN 35 ELSE 34 + least(30, length(s) - 70) END AS INTEGER) AS orf_stop,
CASE kind WHEN 0 THEN '11:40:' || (3 - skip) % 3 WHEN 1 THEN '21:50:' || (3 - skip) % 3 WHEN 2 THEN '11:20:' || (3 - skip) % 3 || ' 31:45:' || (10 - skip) % 3
  ELSE '61:70:' || (3 - skip) % 3 || ' 31:45:' || (10 - skip) % 3 || ' 12:20:' || (25 - skip) % 3 END AS exons
FROM (SELECT id, accession, genename, id % 4 AS kind, id % 3 AS skip, mrna_seq AS s FROM genome WHERE length(mrna_seq) >= 90)"""
    ),
)
def _(spark, d):
    path = work_dir(spark, "genbank")
    _records(spark, d).write.text(path)
    cds = readers.read_genbank_cds(spark, path, 30, True)
    return cds.withColumn("exons", F.array_join(F.transform("exons", lambda e: F.concat_ws(":", e["lo"], e["hi"], e["frame"])), " "))


_PLACED = "SELECT id, substr(w, p + 1, 1) AS base, stem FROM placed JOIN (SELECT id, w FROM win) USING (id)"


@query(
    "p4_gc_of_stems",
    _g(
        f"SELECT id, round(100.0 * count(*) FILTER (WHERE stem IS NOT NULL AND base IN ('G', 'C')) / nullif(count(stem), 0), 1) AS gc FROM ({_PLACED}) GROUP BY id",
        SITES_SQL, _BRACKETS, _EDGES, _STEMS,
    ),
)
def _(spark, d):
    return _tracks(spark, d).join(_behind(spark, d).select("id", "sequence"), "id").select("id", S.gc_stems(F.col("sequence"), F.col("parsed")).alias("gc"))


def _ct(spark, d):
    windows = _behind(spark, d).select("id", "sequence", F.translate("sequence", "ACGT", METHODS["nupack"]).alias("parens"))
    return signals.connect_table(structure.with_partners(windows), "AAATTTA")


@query(
    "k5_connect_tables",
    _g(
        """SELECT b.id, CAST(q AS INTEGER) AS position, substr('AAATTTA' || w, CAST(q AS INTEGER), 1) AS base, CAST(q - 1 AS INTEGER) AS before,
CAST(CASE WHEN q < 107 THEN q + 1 ELSE 0 END AS INTEGER) AS after, CAST(coalesce(partner, 0) AS INTEGER) AS partner
FROM (SELECT id, w, unnest(generate_series(1, 107)) AS q FROM win) b LEFT JOIN mates x ON x.id = b.id AND x.p + 8 = b.q""",
        SITES_SQL, _BRACKETS, _EDGES,
        "mates AS (SELECT id, i AS p, j + 8 AS partner FROM ed WHERE m = 'nupack' UNION ALL SELECT id, j, i + 8 FROM ed WHERE m = 'nupack')",
    ),
)
def _(spark, d):
    return _ct(spark, d)


@query(
    "a33_composition_by_sequence",
    _g(
        """SELECT id, kind, slots, key, count(*) AS n FROM (SELECT id, unnest([{'kind': 'base', 'slots': '1', 'key': c[1]}, {'kind': 'base', 'slots': '2', 'key': c[2]}, {'kind': 'base', 'slots': '3', 'key': c[3]},
  {'kind': 'pair', 'slots': '1-2', 'key': c[1:2]}, {'kind': 'pair', 'slots': '2-3', 'key': c[2:3]}, {'kind': 'pair', 'slots': '1-3', 'key': c[1] || c[3]},
  {'kind': 'pair', 'slots': '3-1', 'key': c[3] || following[1]}, {'kind': 'codon', 'slots': '', 'key': c}], recursive := true)
  FROM (SELECT id, c, lead(c) OVER (PARTITION BY id ORDER BY k) AS following FROM (SELECT id, unnest(list) AS c, unnest(range(len(list))) AS k FROM
    (SELECT id, regexp_extract_all(mrna_seq, '.{3}') AS list FROM genome)))) WHERE key IS NOT NULL GROUP BY ALL"""
    ),
)
def _(spark, d):
    return scan.composition_by_sequence(genome(spark, d))


def _framed(spark, d):
    """Transcripts whose ORF is their middle third."""
    third = F.floor(F.length("mrna_seq") / 3).cast("int")
    return genome(spark, d).withColumn("orf_start", third + 1).withColumn("orf_stop", 2 * third)


@query(
    "a27_stop_distances_by_region",
    _g(
        """SELECT region, CAST(frame AS INTEGER) AS frame, CAST(distance AS INTEGER) AS distance, count(*) AS n FROM (SELECT region, frame, k - lag(k) OVER (PARTITION BY id, region, frame ORDER BY k) AS distance FROM
  (SELECT id, region, frame, unnest(list) AS codon, unnest(range(len(list))) AS k FROM (SELECT id, region, frame, regexp_extract_all(substr(s, CAST(frame + 1 AS INTEGER)), '.{3}') AS list FROM
    (SELECT id, '5utr' AS region, substr(mrna_seq, 1, length(mrna_seq) // 3) AS s FROM genome UNION ALL
     SELECT id, 'orf', substr(mrna_seq, length(mrna_seq) // 3 + 1, length(mrna_seq) // 3) FROM genome UNION ALL
     SELECT id, '3utr', substr(mrna_seq, 2 * (length(mrna_seq) // 3) + 1) FROM genome), (VALUES (0), (1), (2)) AS f(frame)))
  WHERE codon IN ('TAA', 'TAG', 'TGA')) WHERE distance IS NOT NULL GROUP BY ALL"""
    ),
)
def _(spark, d):
    return scan.stop_distances_by_region(_framed(spark, d))


def _aligned(spark, d):
    return scan.find_slipsites(genome(spark, d), (50,)).select(F.concat_ws(":", "id", "start").alias("id"), F.col("slipsite").alias("sequence"))


_LETTERS = "al AS (SELECT id || ':' || start AS id, CAST(p AS INTEGER) AS p, substr(slipsite, CAST(p + 1 AS INTEGER), 1) AS b FROM sites, range(7) AS t(p))"


@query("a28_column_composition", _g('SELECT p AS "column", b AS base, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p), 4) AS share FROM al GROUP BY p, b', SITES_SQL, _LETTERS))
def _(spark, d):
    return signals.column_composition(_aligned(spark, d))


@query(
    "a28_column_pairs",
    _g(
        """SELECT c1, c2, b1, b2, n, round(n / sum(n) OVER (PARTITION BY c1, c2), 4) AS joint,
round(n * sum(n) OVER (PARTITION BY c1, c2) / (sum(n) OVER (PARTITION BY c1, c2, b1) * sum(n) OVER (PARTITION BY c1, c2, b2)), 4) AS ratio
FROM (SELECT x.p AS c1, y.p AS c2, x.b AS b1, y.b AS b2, count(*) AS n FROM al x JOIN al y ON x.id = y.id AND x.p < y.p GROUP BY ALL)""",
        SITES_SQL, _LETTERS,
    ),
)
def _(spark, d):
    return signals.column_pairs(_aligned(spark, d))


def _tail(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * abs({x}) / sqrt(2.0::DOUBLE)))"
    poly = "1.061405429::DOUBLE"
    for c in ("-1.453152027", "1.421413741", "-0.284496736", "0.254829592"):
        poly = f"({c}::DOUBLE + {t} * {poly})"
    tail = f"({t} * {poly} * exp(-({x}) * ({x}) / 2.0::DOUBLE) / 2.0::DOUBLE)"
    return f"CASE WHEN {x} >= 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END"


@query(
    "a29_histogram_with_normal",
    _m(
        f"""SELECT species, bin, n, round(n / total, 4) AS share, round({_tail("b")} - ({_tail("a")}), 4) AS expected, round(mean, 4) AS mean, round(variance, 4) AS variance, round(sd, 4) AS sd FROM
(SELECT species, bin, n, total, mean, variance, sd, (lo + w * bin - mean) / sd AS a, (lo + w * (bin + 1) - mean) / sd AS b FROM
  (SELECT species, CAST(least(bins - 1, floor((zscore - lo) / w)) AS INTEGER) AS bin, count(*) AS n, any_value(total) AS total, any_value(lo) AS lo, any_value(w) AS w, any_value(mean) AS mean,
    any_value(variance) AS variance, any_value(sd) AS sd FROM points JOIN (SELECT *, (hi - lo) / bins AS w FROM (SELECT *, floor(2 * pow(total, 0.4)) AS bins FROM
    (SELECT species, min(zscore) AS lo, max(zscore) AS hi, count(*) AS total, avg(zscore) AS mean, var_samp(zscore) AS variance, stddev_samp(zscore) AS sd FROM points GROUP BY species))) USING (species) GROUP BY ALL))"""
    ),
)
def _(spark, d):
    return signals.histogram_with_normal(points(spark, d), "species", "zscore")


_CELLS = """cells AS (SELECT CAST(round(mfe * 10) AS BIGINT) AS mfe10, CAST(round(zscore * 100) AS BIGINT) AS z100, count(*) AS n, count(*) FILTER (WHERE knotp) AS knotted,
  count(DISTINCT accession) AS genes FROM points GROUP BY ALL)"""


@query(
    "a10_cloud_cells",
    _m(
        """SELECT mfe10, z100, n, knotted, genes, round(n / (SELECT max(n) FROM cells), 4) AS share,
CASE WHEN mfe10 < (SELECT avg(mfe) * 10 FROM points) THEN 'low' ELSE 'high' END || '/' || CASE WHEN z100 < (SELECT avg(zscore) * 100 FROM points) THEN 'low' ELSE 'high' END AS quadrant FROM cells""",
        _CELLS,
    ),
)
def _(spark, d):
    return P.cloud_cells(points(spark, d))


@query("a10_cloud_members", _m("SELECT CAST(round(mfe * 10) AS BIGINT) AS mfe10, CAST(round(zscore * 100) AS BIGINT) AS z100, accession, count(*) AS n FROM points GROUP BY ALL"))
def _(spark, d):
    return P.cloud_members(points(spark, d))


@query(
    "j10_lookups",
    _m(
        """SELECT m.id, m.accession, p.genename, p.brand, s.home FROM (SELECT id, accession, start % 40 AS home_id FROM mfe) m
LEFT JOIN (SELECT 'ACC' || p_partkey AS accession, p_name AS genename, p_brand AS brand FROM part WHERE p_partkey % 4 <> 0) p USING (accession)
LEFT JOIN (SELECT n_nationkey AS home_id, n_name AS home FROM nation) s USING (home_id)"""
    ),
)
def _(spark, d):
    m = points(spark, d).select("id", "accession", (F.col("start") % 40).alias("home_id"))
    genes = read(spark, d, "part").where("p_partkey % 4 <> 0").withColumn("accession", F.concat(F.lit("ACC"), "p_partkey"))
    named = P.lookup(m, genes, {"accession": "accession"}, {"p_name": "genename", "p_brand": "brand"})
    return P.lookup(named, read(spark, d, "nation"), {"home_id": "n_nationkey"}, {"n_name": "home"}).drop("home_id")


@query("x1_union_methods", _m(" UNION ".join(f"SELECT accession, start, seqlength FROM mfe WHERE mfe_method = 'method{k}'" for k in (0, 2))))
def _(spark, d):
    return P.union_methods(points(spark, d), ["method0", "method2"], ["accession", "start", "seqlength"])


@query(
    "j16_related_rows",
    _m(
        """SELECT g.accession, genename, coalesce(kind, 'none') AS kind, item, coalesce(n, 0) AS n FROM genes g LEFT JOIN (
SELECT accession, 'site' AS kind, start || ' ' || slipsite AS item, count(*) AS n FROM predictions GROUP BY ALL UNION ALL
SELECT 'ACC' || (o_orderkey % 2000 + 1), 'variant', CAST(1 + o_custkey % 1000 AS VARCHAR), count(*) FROM orders GROUP BY ALL UNION ALL
SELECT 'ACC' || p_partkey, 'xref', 'GeneID:' || p_size, count(*) FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL) USING (accession)""",
        _PREDICTIONS, _GENES,
    ),
)
def _(spark, d):
    snps = read(spark, d, "orders").select(F.concat(F.lit("ACC"), F.col("o_orderkey") % 2000 + 1).alias("accession"), (1 + F.col("o_custkey") % 1000).alias("position"))
    xrefs = read(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("ACC"), "p_partkey").alias("accession"), F.concat(F.lit("GeneID:"), "p_size").alias("xref"))
    return P.related_rows(_genes(spark, d), _predictions(spark, d), snps, xrefs)


_KEPT = "kept AS (SELECT min(id) AS id FROM mfe GROUP BY accession, seqlength, mfe_method, pairs)"


@query("w2_without_duplicates", _m("SELECT id, 'mfe' AS kind FROM mfe JOIN kept USING (id) UNION ALL SELECT m.id, 'boot' FROM mfe m JOIN kept USING (id) WHERE m.id % 2 = 0", _KEPT))
def _(spark, d):
    m = points(spark, d)
    boot = m.where("id % 2 = 0").select(F.col("id").alias("mfe_id"))
    kept, models = P.without_duplicates(m, boot, ["accession", "seqlength", "mfe_method", "pairs"])
    return kept.select("id", F.lit("mfe").alias("kind")).unionByName(models.select(F.col("mfe_id").alias("id"), F.lit("boot").alias("kind")))



_PEPTIDE = f"array_to_string(list_transform(regexp_extract_all(mrna_seq, '[ACGT]{{3}}'), lambda c: {_CODON_MAP}[c]), '')"


@query(
    "p6_up_to_the_stop",
    _g(f"""SELECT id, regexp_extract(mrna_seq, '{_OPEN}') AS open_bases, split_part({_PEPTIDE}, '*', 1) AS peptide FROM genome"""),
)
def _(spark, d):
    seq = F.col("mrna_seq")
    return genome(spark, d).select("id", S.until_stop(seq).alias("open_bases"), S.upto_stop(S.translate(seq)).alias("peptide"))


@query(
    "p7_heptamers",
    _g(
        """SELECT id, h AS heptamer, regexp_full_match(h, '(AAA|CCC|GGG|TTT)(AAA|TTT)[ACGT]') AS slippery, regexp_full_match(h, '(AAA|CCC|GGG|TTT)(AAA|TTT)[ACT]') AS canonical
FROM (SELECT id, CASE WHEN id % 30 + 7 <= length(mrna_seq) THEN substr(mrna_seq, CAST(id % 30 + 1 AS INTEGER), 7) END AS h FROM genome
  UNION ALL SELECT id, CASE WHEN start + 6 <= length(mrna_seq) THEN slipsite END FROM sites)""",
        SITES_SQL,
    ),
)
def _(spark, d):
    g = genome(spark, d)
    places = g.select("id", "mrna_seq", (F.col("id") % 30 + 1).cast("int").alias("at")).unionByName(scan.find_slipsites(g, (50,)).select("id", "mrna_seq", F.col("start").alias("at")))
    rows = places.select("id", S.heptamer_at(F.col("mrna_seq"), F.col("at")).alias("heptamer"))
    return rows.select("id", "heptamer", S.is_slippery(F.col("heptamer")).alias("slippery"), S.is_slippery(F.col("heptamer"), True).alias("canonical"))


@query(
    "p8_p9_labels",
    """SELECT n_nationkey AS id, upper(n_name[1]) || replace(lower(n_name[2:]), '_', ' ') || ' sp' AS label, 'X_' || n_nationkey || '_2' AS dotless, 'X.' || n_nationkey AS plain,
CASE WHEN n_nationkey BETWEEN 1 AND 16 THEN (string_split('I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI', ' '))[n_nationkey] ELSE 'chr' || n_nationkey END AS chromosome FROM nation""",
)
def _(spark, d):
    key, accession = F.concat(F.lower("n_name"), F.lit("__sp")), F.concat(F.lit("SGDID:X."), "n_nationkey", F.lit(".2"))
    return read(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), S.species_label(key).alias("label"), S.clean_accession(accession, "underscore").alias("dotless"),
        S.clean_accession(accession).alias("plain"), S.chromosome_label(F.concat(F.lit("chr"), "n_nationkey")).alias("chromosome"),
    )


@query("p11_relative_position", _m("""SELECT id, start - 1 AS distance, CAST(round(100.0 * (start - 1) / (orf_stop - 1)) AS INTEGER) AS percent FROM mfe JOIN (SELECT accession, orf_stop FROM genes) USING (accession)""", _GENES))
def _(spark, d):
    both = points(spark, d).join(_genes(spark, d).select("accession", "orf_start", "orf_stop"), "accession")
    return both.select("id", S.relative_position(F.col("start"), F.col("orf_start"), F.col("orf_stop")).alias("r")).select("id", "r.*")


_RANDS = ["bases", "codons"]


@query(
    "a35_missing_randomizations",
    _m(
        """SELECT a.mfe_id, r AS rand_method, m AS mfe_method FROM (SELECT DISTINCT id AS mfe_id FROM mfe) a, (VALUES ('bases'), ('codons')) AS x(r), (VALUES ('method0'), ('method1')) AS y(m)
WHERE NOT EXISTS (SELECT 1 FROM bt b WHERE b.mfe_id = a.mfe_id AND b.rand_method = r AND b.mfe_method = m)""",
        "bt AS (SELECT id AS mfe_id, CASE WHEN pairs % 2 = 0 THEN 'bases' ELSE 'codons' END AS rand_method, mfe_method FROM mfe WHERE pairs % 5 <> 0)",
    ),
)
def _(spark, d):
    m = points(spark, d)
    boot = m.where("pairs % 5 <> 0").select(F.col("id").alias("mfe_id"), F.when(F.col("pairs") % 2 == 0, "bases").otherwise("codons").alias("rand_method"), "mfe_method")
    return P.missing_randomizations(m, boot, _RANDS, ["method0", "method1"])


_METHODS = [f"method{k}" for k in range(3)]


@query(
    "a38_species_by_method",
    _m(
        f"""SELECT species, {', '.join(f"count(*) FILTER (WHERE mfe_method = '{m}') AS {m}_folds, count(*) FILTER (WHERE mfe_method = '{m}' AND knotp) AS {m}_knotted, count(*) FILTER (WHERE mfe_method = '{m}' AND low) AS {m}_significant" for m in _METHODS)}
FROM (SELECT *, mfe < avg(mfe) OVER w - stddev_pop(mfe) OVER w AND zscore < avg(zscore) OVER w - stddev_pop(zscore) OVER w AS low FROM points WINDOW w AS (PARTITION BY species, mfe_method)) GROUP BY species"""
    ),
)
def _(spark, d):
    return P.species_by_method(points(spark, d), _METHODS)


@query(
    "a25_paired_expression",
    """SELECT gene, count(*) AS n, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS sd, round(var_pop(e), 4) AS variance, round(covar_pop(healthy, cancer), 4) + 0::DOUBLE AS covariance,
CASE WHEN stddev_pop(healthy) * stddev_pop(cancer) > 0 THEN round(corr(healthy, cancer), 4) + 0::DOUBLE END AS correlation
FROM (SELECT *, exp(cancer - healthy) AS e FROM (SELECT l_partkey AS gene, l_extendedprice / 39973.0::DOUBLE AS healthy, l_quantity / 17.3::DOUBLE AS cancer FROM lineitem)) GROUP BY gene""",
)
def _(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), (F.col("l_extendedprice") / 39973.0).alias("healthy"), (F.col("l_quantity") / 17.3).alias("cancer"))
    return P.expression_stats(rows)


@query(
    "f9_long_extensions",
    _g(
        f"""SELECT id, start FROM (SELECT id, start, CAST(length(regexp_extract(substr(mrna_seq, start + 6), '{_OPEN}')) AS INTEGER) AS bp,
  length(regexp_replace(mrna_seq, 'A+$', '')) AS body, length(mrna_seq) AS n FROM sites) WHERE bp > 150 AND bp // 3 > 30 AND NOT (start + 5 >= body AND start + 5 < n)""",
        SITES_SQL,
    ),
)
def _(spark, d):
    g = genome(spark, d)
    both = scan.alternative_orfs(g).select("id", "start", "minus_orf").join(scan.minus_stop_distance(g).select("id", "start", "bp_mstop"), ["id", "start"])
    return P.long_extensions(both).select("id", "start")
