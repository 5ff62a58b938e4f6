"""Queries on files' records, null models, reads, signals and agreement, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import nulls, scan, signals, structure
from shiftlens.plans.registry import _PAIRS_SQL, _g, _m, _structures, query
from shiftlens.sources.fixtures import SITES_SQL, genome, mfe, points, read
from shiftlens.sources.readers import fasta_record, parse_fasta

_FASTA = "rtrim('>' || accession || ' ' || genename || chr(10) || regexp_replace(mrna_seq, '(.{80})', '\\1' || chr(10), 'g'), chr(10)) || CASE WHEN mrna_seq = '' THEN chr(10) ELSE '' END"
_GENOME_LETTERS = "translate(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTAACTTGCTGATCAGTCATGCAT')"
_HITS = "hits AS (SELECT l_partkey AS gene, CAST((l_orderkey * 7 + l_linenumber) % 500 AS INTEGER) AS spot FROM lineitem), genes AS (SELECT p_partkey AS gene, CAST(p_size * 10 AS INTEGER) AS length FROM part)"
_W50 = "v AS (SELECT id, start, substr(mrna_seq, start + 7, 50) AS w FROM sites WHERE length(mrna_seq) >= start + 56)"
_SEEDED = _W50 + ", c AS (SELECT id, start, iteration, i, c, md5('7|' || id || '|' || start || '|' || iteration || '|' || i) AS k FROM (SELECT id, start, unnest(regexp_extract_all(w, '[ACGT]{3}')) AS c, CAST(unnest(range(16)) AS INTEGER) AS i FROM v), (SELECT CAST(unnest(generate_series(1, 10)) AS INTEGER) AS iteration))"
_DRAWN = "CAST('0x' || substr(k, 1, 7) AS BIGINT)"


def _records(spark, d):
    return genome(spark, d).select(fasta_record(F.concat_ws(" ", "accession", "genename"), F.col("mrna_seq")).alias("value"))


@query("k2_fasta_records", _g(f"SELECT {_FASTA} AS value FROM genome"))
def _(spark, d):
    return _records(spark, d)


@query("s1_fasta", _g("SELECT accession, mrna_seq, CAST(length(mrna_seq) AS INTEGER) AS orf_stop FROM genome"))
def _(spark, d):
    return parse_fasta(_records(spark, d)).select("accession", "mrna_seq", "orf_stop")


@query("p4_gc_content", _g("SELECT id, CASE WHEN mrna_seq <> '' THEN round(100.0 * length(regexp_replace(mrna_seq, '[^GC]', '', 'g')) / length(mrna_seq), 1) END AS gc FROM genome"))
def _(spark, d):
    return genome(spark, d).select("id", S.gc_content(F.col("mrna_seq")).alias("gc"))


def _windows(spark, d):
    return scan.keep_coding(scan.find_slipsites(genome(spark, d), (50,)), do_utr=True).select("id", "start", "slipsite", "sequence")


def _random(kind):
    def run(spark, d):
        made = nulls.RANDOMIZERS[kind](F.col("sequence"), F.lit(7), F.col("id"), F.col("start"), F.col("iteration"))
        return nulls.fan_out(_windows(spark, d), 10).select("id", "start", "iteration", made.alias("shuffled"))

    return run


_LITERALS = ", ".join(f"'{c}'" for c in nulls.SENSE)
_SYNONYMS = "MAP {" + ", ".join(f"'{c}': {own}" for c, own in nulls.SYNONYMS.items()) + "}"
query("r3_codon_shuffle", _g("SELECT id, start, iteration, string_agg(c, '' ORDER BY k, c) AS shuffled FROM c GROUP BY ALL", SITES_SQL, _SEEDED))(_random("codons"))
query("r4_random_sense", _g(f"SELECT id, start, iteration, string_agg(([{_LITERALS}])[{_DRAWN} % 61 + 1], '' ORDER BY i) AS shuffled FROM c GROUP BY ALL", SITES_SQL, _SEEDED))(_random("sense"))
query("r5_same_protein", _g(f"SELECT id, start, iteration, string_agg(o[{_DRAWN} % len(o) + 1], '' ORDER BY i) AS shuffled FROM (SELECT *, element_at({_SYNONYMS}, c)[1] AS o FROM c) GROUP BY ALL", SITES_SQL, _SEEDED))(_random("protein"))
query("r6_random_middle", _g(f"SELECT id, start, iteration, string_agg(substr(c, 1, 1) || substr('ACGT', {_DRAWN} % 4 + 1, 1) || substr(c, 3, 1), '' ORDER BY i) AS shuffled FROM c GROUP BY ALL", SITES_SQL, _SEEDED))(_random("middle"))
query("r8_drawn_doublets")(lambda spark, d: nulls.doublet_iterations(_windows(spark, d), ["id", "start"], 10))


@query("g1_bulk_fold", _g(f"SELECT id, start, CAST(coalesce((SELECT sum(e) FROM (SELECT unnest(list_transform(range(1, 50), lambda k: substr(w, k, 2))) AS pair) JOIN (VALUES {', '.join(f'''('{k}', {round(x * 100)})''' for k, x in S.STACK.items())}) AS t(pair, e) USING (pair)), 0) AS INTEGER) AS mfe FROM v", SITES_SQL, _W50))
def _(spark, d):
    return nulls.bulk_fold(_windows(spark, d), S.stack_energy).select("id", "start", "mfe")


def _hits(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 500).cast("int").alias("at"))


def _genes(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") * 10).cast("int").alias("length"))


@query("a19_position_depth", f"WITH {_HITS} SELECT gene, count(*) AS places, count(n) AS covered, CAST(coalesce(sum(n), 0) AS BIGINT) AS reads FROM (SELECT gene, CAST(unnest(range(length)) AS INTEGER) AS spot FROM genes) LEFT JOIN (SELECT gene, spot, count(*) AS n FROM hits GROUP BY ALL) USING (gene, spot) GROUP BY gene")
def _(spark, d):
    return signals.position_depth(_hits(spark, d), _genes(spark, d)).groupBy("gene").agg(F.count("*").alias("places"), F.count(F.when(F.col("n") > 0, 1)).alias("covered"), F.sum("n").alias("reads"))


_FRAMES = ", ".join(f"count(*) FILTER (WHERE (spot + 15) % 3 = {k}) AS f{k}" for k in range(3))
_RATIO = f"r AS (SELECT *, round((f0 * 10.0 + f1 * 10 + 1) / (f2 * 10 + 1), 4) AS ratio FROM (SELECT gene, {_FRAMES} FROM hits GROUP BY gene))"


def _ratio(spark, d):
    depth = _hits(spark, d).groupBy("gene", F.pmod(F.col("at") + 15, F.lit(3)).alias("frame")).agg(F.count("*").alias("n"))
    return signals.frame_ratio(depth, "gene")


@query("a21_frame_ratio", f"WITH {_HITS}, {_RATIO} SELECT * FROM r")
def _(spark, d):
    return _ratio(spark, d)


@query("w3_top_genes", f"WITH {_HITS}, {_RATIO} SELECT gene, f0, ratio FROM r ORDER BY f0 DESC, gene LIMIT 3999")
def _(spark, d):
    return _ratio(spark, d).orderBy(F.desc("f0"), "gene").limit(3999).orderBy("ratio", "gene").select("gene", "f0", "ratio")


@query("a22_coverage_rpkm", f"WITH {_HITS} SELECT gene, reads, round(reads / length, 4) AS coverage, round(reads * 1e9 / length / (SELECT count(*) FROM hits), 3) AS rpkm FROM (SELECT gene, count(*) AS reads FROM hits GROUP BY gene) JOIN genes USING (gene)")
def _(spark, d):
    return signals.coverage_rpkm(_hits(spark, d), _genes(spark, d))


@query("a24_pars_scores", """WITH v AS (SELECT l_partkey AS orf, CAST(l_linenumber AS INTEGER) AS position, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS v, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS s FROM lineitem GROUP BY ALL)
SELECT orf, position, round(coalesce(lead(log2((v + 1) / (s + 1))) OVER (PARTITION BY orf ORDER BY position), 0), 3) + 0 AS score FROM v WHERE v IS NOT NULL AND s IS NOT NULL""")
def _(spark, d):
    tags = lambda flag: read(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("orf"), F.col("l_linenumber").cast("int").alias("position")).agg(F.sum("l_quantity").alias("value"))
    return signals.pars_scores(tags("R"), tags("N")).withColumn("score", F.col("score") + F.lit(0))


_Z = "abs((mfe - m) / s) / sqrt(2.0)"
_CDF = f"(CASE WHEN mfe >= m THEN 1 - q ELSE q END)"


@query("a30_ppcc", _m(f"""SELECT accession, round(corr(r / (n + 1), {_CDF}), 4) AS ppcc FROM (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z) / 2 AS q FROM (
SELECT *, CAST({_Z} AS DOUBLE) AS z, 1.0 / (1.0 + CAST(0.3275911 AS DOUBLE) * {_Z}) AS t FROM (SELECT accession, mfe, avg(mfe) OVER w AS m, stddev_samp(mfe) OVER w AS s, count(*) OVER w AS n, row_number() OVER (PARTITION BY accession ORDER BY mfe) AS r FROM mfe WINDOW w AS (PARTITION BY accession)) WHERE s > 0)) GROUP BY accession"""))
def _(spark, d):
    return signals.ppcc(mfe(spark, d), "accession", "mfe")


@query("a29_value_histogram", _m("""SELECT accession, CASE WHEN hi > lo THEN CAST(least(b - 1, floor((mfe - lo) / (hi - lo) * b)) AS INTEGER) ELSE 0 END AS bin, count(*) AS n, round(count(*) / any_value(c), 4) AS share
FROM (SELECT *, floor(2 * pow(c, 0.4)) AS b FROM (SELECT accession, mfe, min(mfe) OVER w AS lo, max(mfe) OVER w AS hi, count(*) OVER w AS c FROM mfe WINDOW w AS (PARTITION BY accession))) GROUP BY ALL"""))
def _(spark, d):
    return signals.value_histogram(mfe(spark, d), "accession", "mfe")


@query("a28_mutual_information", _g("""SELECT c1, c2, abs(round(sum(n / t * log2(n * t / (a * b))), 4)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY c1, c2) AS t, sum(n) OVER (PARTITION BY c1, c2, b1) AS a, sum(n) OVER (PARTITION BY c1, c2, b2) AS b
FROM (SELECT CAST(x - 1 AS INTEGER) AS c1, CAST(y - 1 AS INTEGER) AS c2, substr(slipsite, x, 1) AS b1, substr(slipsite, y, 1) AS b2, CAST(count(*) AS DOUBLE) AS n FROM sites, generate_series(1, 7) AS f(x), generate_series(1, 7) AS g(y) WHERE x < y GROUP BY ALL)) GROUP BY c1, c2""", SITES_SQL))
def _(spark, d):
    sites = scan.find_slipsites(genome(spark, d), (50,)).select(F.concat_ws(":", "id", "start").alias("id"), F.col("slipsite").alias("sequence"))
    return signals.mutual_information(sites).withColumn("bits", F.abs("bits"))


@query("q13_inverted_repeats", _g("""SELECT a.id, CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j FROM km a JOIN km b ON a.id = b.id AND b.word = reverse(translate(a.word, 'ACGT', 'TGCA')) AND b.k - a.k >= 9 AND b.k + 6 - a.k <= 50""", SITES_SQL, _W50, "km AS (SELECT id || ':' || start AS id, k, substr(w, k + 1, 6) AS word FROM v, generate_series(0, 44) AS t(k))"))
def _(spark, d):
    return signals.inverted_repeats(_windows(spark, d).select(F.concat_ws(":", "id", "start").alias("id"), "sequence"), 6, 3, 50)


@query("j14_mirna_targets", _g(f"""SELECT mirna, v.id || ':' || v.start AS id, CAST(k AS INTEGER) AS at FROM v, generate_series(0, 43) AS t(k), (SELECT p_partkey AS mirna, reverse(translate(substr({_GENOME_LETTERS}, 2, 7), 'ACGT', 'TGCA')) AS word FROM part) WHERE word = substr(w, k + 1, 7)""", SITES_SQL, _W50))
def _(spark, d):
    letters = F.translate(F.regexp_replace(F.lower("p_name"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTAACTTGCTGATCAGTCATGCAT")
    mirnas = read(spark, d, "part").select(F.col("p_partkey").alias("mirna"), letters.alias("sequence"))
    return signals.mirna_targets(mirnas, _windows(spark, d).select(F.concat_ws(":", "id", "start").alias("id"), "sequence"))


@query("t9_agreement", f"WITH {_PAIRS_SQL}, k3 AS (SELECT id, i, j, 1 + CAST((i + j + id) % 2 = 0 AS INTEGER) + CAST((i + id) % 3 = 0 AS INTEGER) AS k FROM e) SELECT id, " + ", ".join(f"count(*) FILTER (WHERE k = {k}) AS by_{k}" for k in (1, 2, 3)) + " FROM k3 GROUP BY id")
def _(spark, d):
    e = structure.parens_to_pairs(_structures(spark, d))
    said = [e, e.where("(i + j + id) % 2 = 0"), e.where("(i + id) % 3 = 0")]
    tagged = [x.withColumn("mfe_method", F.lit(f"m{k}")) for k, x in enumerate(said)]
    return signals.agreement(tagged[0].union(tagged[1]).union(tagged[2]), ["m0", "m1", "m2"])


@query("t11_compare_energies", _m("SELECT accession, start, seqlength, " + ", ".join(f"round(min(mfe) FILTER (WHERE mfe_method = 'method{k}'), 4) AS method{k}" for k in range(3)) + " FROM mfe GROUP BY ALL"))
def _(spark, d):
    return signals.compare_energies(mfe(spark, d), ["method0", "method1", "method2"])


@query("k5_bpseq", f"WITH {_PAIRS_SQL} SELECT s.id, CAST(p AS INTEGER) AS position, CAST(coalesce(x.partner, 0) AS INTEGER) AS partner FROM s, generate_series(1, length(parens)) AS t(p) LEFT JOIN (SELECT id, i + 1 AS at, j + 1 AS partner FROM e UNION ALL SELECT id, j + 1, i + 1 FROM e) x ON x.id = s.id AND x.at = p")
def _(spark, d):
    s = _structures(spark, d)
    return signals.to_bpseq(s, structure.parens_to_pairs(s))


@query("w5_unlike_previous", _m("SELECT accession, id, mfe_method FROM (SELECT *, lag(mfe_method) OVER (PARTITION BY accession ORDER BY id, mfe_method) AS p FROM mfe) WHERE p IS NULL OR p <> mfe_method"))
def _(spark, d):
    return signals.unlike_previous(mfe(spark, d), "accession", ["id", "mfe_method"], "mfe_method").select("accession", "id", "mfe_method")


@query("u2_refresh_genome_id", _m("SELECT id, CASE WHEN genome_id % 3 <> 0 THEN genome_id + 1000000 WHEN pairs % 2 = 0 THEN -1 ELSE genome_id END AS genome_id FROM mfe"))
def _(spark, d):
    """The current table has new ids, and lacks a third of the accessions."""
    m = mfe(spark, d)
    stale = m.select("id", "accession", F.when(F.col("pairs") % 2 == 0, -1).otherwise(F.col("genome_id")).alias("genome_id"))
    current = m.where("genome_id % 3 <> 0").select("accession", (F.col("genome_id") + 1000000).alias("genome_id")).distinct()
    return signals.refresh(stale, current, "accession", "genome_id").select("id", "genome_id")


_TAILED = "SELECT accession, id, CASE id % 3 WHEN 0 THEN mfe_method WHEN 1 THEN substr(mfe_method, 4) ELSE substr(mfe_method, 7) END AS said FROM mfe"


@query("w5_suffixes", _m(f"SELECT accession, id, said FROM (SELECT *, lag(said) OVER (PARTITION BY accession ORDER BY id, said) AS p FROM ({_TAILED})) WHERE p IS NULL OR NOT ends_with(p, said)"))
def _(spark, d):
    said = F.when(F.col("id") % 3 == 0, F.col("mfe_method")).when(F.col("id") % 3 == 1, F.expr("substring(mfe_method, 4)")).otherwise(F.expr("substring(mfe_method, 7)"))
    rows = mfe(spark, d).select("accession", "id", said.alias("said"))
    return signals.unlike_previous(rows, "accession", ["id", "said"], "said")


@query("k6_series_json")
def _(spark, d):
    return signals.series_json(points(spark, d).groupBy("species", "mfe_method", "pairs").agg(F.round(F.avg("mfe"), 3).alias("mfe")), "species", "mfe_method", "pairs", "mfe")
