"""Every registered query of the library and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import nulls, scan, stats, structure
from shiftlens.sources.fixtures import GENOME_SQL, MFE_SQL, POINTS_SQL, SITES_SQL, genome, mfe, points, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CODON_VALUES = ", ".join(f"('{c}', '{a}')" for c, a in zip(S.CODONS, S.AMINO))
STACK_VALUES = ", ".join(f"('{k}', {round(v * 100)})" for k, v in S.STACK.items())


def query(name: str, sql: str | None = None):
    def keep(f):
        f.__name__ = f.__qualname__ = name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _g(body: str, *more: str) -> str:
    return "WITH " + ", ".join([GENOME_SQL, *more]) + "\n" + body


def _m(body: str, *more: str) -> str:
    return "WITH " + ", ".join([MFE_SQL, POINTS_SQL, *more]) + "\n" + body


@query("q1_slipsites_by_species", _g("SELECT species, slipsite, count(*) AS sites FROM sites GROUP BY ALL", SITES_SQL))
def _(spark, d):
    return scan.find_slipsites(genome(spark, d), (100,)).groupBy("species", "slipsite").agg(F.count("*").alias("sites"))


@query("q1_windows", _g("SELECT id, accession, start, slipsite, CAST(n AS INTEGER) AS seqlength, substr(mrna_seq, start + 7, n) AS sequence FROM sites, (VALUES (100), (75), (50)) AS l(n)", SITES_SQL))
def _(spark, d):
    return scan.find_slipsites(genome(spark, d)).select("id", "accession", "start", "slipsite", "seqlength", "sequence")


@query("q3_keep_coding", _g("SELECT species, CAST(n AS INTEGER) AS seqlength, count(*) AS windows FROM sites, (VALUES (100), (75), (50)) AS l(n) WHERE length(substr(mrna_seq, start + 7, n)) = n GROUP BY ALL", SITES_SQL))
def _(spark, d):
    return scan.keep_coding(scan.find_slipsites(genome(spark, d))).groupBy("species", "seqlength").agg(F.count("*").alias("windows"))


@query("q4_num_slipsites", _g("SELECT accession, count(start) AS num_slipsite FROM genome LEFT JOIN (SELECT accession, start FROM sites) USING (accession) GROUP BY accession", SITES_SQL))
def _(spark, d):
    g = genome(spark, d)
    return scan.num_slipsites(g, scan.find_slipsites(g, (100,)))


@query("q5_landscape_windows", _g("SELECT id, CAST(s AS INTEGER) AS start, substr(mrna_seq, s + 1, 105) AS sequence FROM genome, generate_series(0, length(mrna_seq) - 105, 15) AS t(s)"))
def _(spark, d):
    return scan.landscape_windows(genome(spark, d)).select("id", "start", "sequence")


@query("q2_window_at", _g("SELECT id, accession, 11 AS start, translate(upper(substr(mrna_seq, 11, 100)), 'RYWS', 'ACAC') AS sequence FROM genome"))
def _(spark, d):
    return scan.window_at(genome(spark, d), 11, 100)


#: Codons before a stop, without lookahead.
_OPEN = "^(?:[ACG][ACGT]{2}|T(?:[CT][ACGT]|A[CT]|G[CGT]))*"
_CODON_MAP = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in zip(S.CODONS, S.AMINO)) + "}"


def _protein_sql(seq: str) -> str:
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({seq}, '[ACGT]{{3}}'), lambda c: element_at({_CODON_MAP}, c)[1]), ''), '')"


@query("q8_minus_stop", _g(f"SELECT id, start, CAST(length(regexp_extract(substr(mrna_seq, start + 6), '{_OPEN}')) AS INTEGER) AS bp_mstop FROM sites", SITES_SQL))
def _(spark, d):
    return scan.minus_stop_distance(genome(spark, d)).select("id", "start", "bp_mstop")


def _orf_sql(name: str, offset: int) -> str:
    tail = f"substr(mrna_seq, start + {offset})"
    return f"""{name} AS (SELECT id, start, CASE WHEN regexp_matches({tail}, '^A+$') THEN NULL ELSE {_protein_sql(f"regexp_extract({tail}, '{_OPEN}')")} END AS peptide FROM sites)"""


@query("q6_alternative_orfs", _g("SELECT id, start, p.peptide AS plus_orf, CAST(length(p.peptide) AS INTEGER) AS plus_length, m.peptide AS minus_orf, CAST(length(m.peptide) AS INTEGER) AS minus_length FROM plus p JOIN minus m USING (id, start)", SITES_SQL, _orf_sql("plus", 5), _orf_sql("minus", 6)))
def _(spark, d):
    return scan.alternative_orfs(genome(spark, d)).select("id", "start", "plus_orf", "plus_length", "minus_orf", "minus_length")


_HEAD = _protein_sql("substr(mrna_seq, 1, start - start % 3)")
_SHIFTED = _protein_sql(f"regexp_extract(substr(mrna_seq, start + 6), '{_OPEN}')")


@query("q7_frameshift_protein", _g(f"SELECT id, start, lower({_HEAD}) || {_SHIFTED} AS fusion FROM sites", SITES_SQL))
def _(spark, d):
    return scan.frameshift_protein(genome(spark, d)).select("id", "start", "fusion")


@query("p_sequence_columns", _g("""SELECT id, translate(upper(mrna_seq), 'T', 'U') AS rna, reverse(translate(mrna_seq, 'ACGT', 'TGCA')) AS revcomp,
substr(mrna_seq, 1, length(mrna_seq) - 1) AS orf, substr(mrna_seq, 1, length(mrna_seq)) AS orf_inclusive, length(regexp_replace(mrna_seq, '[^GC]', '', 'g')) AS gc FROM genome"""))
def _(spark, d):
    s = F.col("mrna_seq")
    return genome(spark, d).select("id", S.to_rna(s).alias("rna"), S.reverse_complement(s).alias("revcomp"), S.orf_slice(s, F.col("orf_start"), F.col("orf_stop")).alias("orf"), S.orf_slice(s, F.col("orf_start"), F.col("orf_stop"), True).alias("orf_inclusive"), F.length(F.regexp_replace(s, "[^GC]", "")).cast("long").alias("gc"))


@query("p5_translate", _g(f"SELECT id, {_protein_sql('mrna_seq')} AS protein FROM genome"))
def _(spark, d):
    return genome(spark, d).select("id", S.translate(F.col("mrna_seq")).alias("protein"))


@query("p16_word_positions", _g("SELECT id, CAST(p AS INTEGER) AS position FROM genome, generate_series(1, length(mrna_seq) - 5, 1) AS t(p) WHERE substr(mrna_seq, p, 6) = 'TTTAAA'"))
def _(spark, d):
    return genome(spark, d).select("id", F.explode(S.word_positions(F.col("mrna_seq"), "TTTAAA")).alias("position"))


@query("p17_minus_track")
def _(spark, d):
    return genome(spark, d).select("id", S.minus_frame_track(F.col("mrna_seq")).alias("track"))


@query("g2_stack_energy", _g(f"SELECT id, CAST(coalesce(sum(e), 0) AS INTEGER) AS energy FROM (SELECT id, unnest(CASE WHEN length(mrna_seq) > 1 THEN list_transform(range(1, length(mrna_seq)), lambda k: substr(mrna_seq, k, 2)) ELSE [''] END) AS word FROM genome) LEFT JOIN (VALUES {STACK_VALUES}) AS w(pair, e) ON pair = word GROUP BY id"))
def _(spark, d):
    return genome(spark, d).select("id", S.stack_energy(F.col("mrna_seq")).alias("energy"))


_KEY = "CAST('0x' || substr(md5('7|' || id || '|' || start || {more} '|' || iteration), 1, 7) AS BIGINT)"
_ORDER = f"""list_transform(list_sort(list_transform(range(n), lambda i: ((((h * 7 + i * {S.STEP}) % {S.PRIME}) * ((h * 7 + i * {S.STEP}) % {S.PRIME}) + i * {S.SHIFT}) % {S.PRIME}
  * ((((h * 7 + i * {S.STEP}) % {S.PRIME}) * ((h * 7 + i * {S.STEP}) % {S.PRIME}) + i * {S.SHIFT}) % {S.PRIME}) + (h * 7 + i * {S.STEP}) % {S.PRIME}) % {S.PRIME} * 2147483648 + i)), lambda v: v % 2147483648)"""
_WINDOWS_SQL = f"""v AS (SELECT id, start, substr(mrna_seq, start + 7, 50) AS w FROM sites WHERE length(mrna_seq) >= start + 56),
h AS (SELECT id, start, w, iteration, CAST(50 AS BIGINT) AS n, {_KEY.format(more='')} AS h FROM v, (SELECT CAST(unnest(generate_series(1, 10)) AS INTEGER) AS iteration)),
n AS (SELECT id, start, iteration, array_to_string(list_transform({_ORDER}, lambda q: substr(w, CAST(q + 1 AS INTEGER), 1)), '') AS s FROM h)"""
_STACKED = "list_sum(list_transform(range(1, CAST(length(s) AS BIGINT)), lambda q: [" + ", ".join(str(round(S.STACK[a + b] * 100)) for a in "ACGT" for b in "ACGT") + "][4 * instr('ACGT', substr(s, CAST(q AS INTEGER), 1)) + instr('ACGT', substr(s, CAST(q + 1 AS INTEGER), 1)) - 4]))"


def _nulls(spark, d):
    windows = scan.keep_coding(scan.find_slipsites(genome(spark, d), (50,)), do_utr=True).select("id", "start", "sequence")
    return nulls.fan_out(windows, 10).withColumn("shuffled", nulls.RANDOMIZERS["bases"](F.col("sequence"), F.lit(7), F.col("id"), F.col("start"), F.col("iteration")))


@query("r2_shuffle", _g("SELECT id, start, iteration, s AS shuffled FROM n", SITES_SQL, _WINDOWS_SQL))
def _(spark, d):
    return _nulls(spark, d).select("id", "start", "iteration", "shuffled")


@query("g4_bootstrap", _g(f"""SELECT id, start, round(avg(e), 2) AS mfe_mean, round(stddev_samp(e), 2) AS mfe_sd, count(*) AS iterations
FROM (SELECT id, start, {_STACKED} AS e FROM n) GROUP BY id, start""", SITES_SQL, _WINDOWS_SQL))
def _(spark, d):
    e = _nulls(spark, d).select("id", "start", S.stack_energy(F.col("shuffled")).alias("e"))
    return e.groupBy("id", "start").agg(F.round(F.avg("e"), 2).alias("mfe_mean"), F.round(F.stddev_samp("e"), 2).alias("mfe_sd"), F.count("*").alias("iterations"))


_CODONS_SQL = """cd AS (SELECT id, frame, unnest(list) AS codon, unnest(range(len(list))) AS k FROM (SELECT id, CAST(frame AS INTEGER) AS frame, regexp_extract_all(substr(s, CAST(frame AS INTEGER) + 1), '[ACGT]{3}') AS list FROM (SELECT id, %s AS s FROM genome), (VALUES (0), (1), (2)) AS f(frame)))"""


@query("a26_codon_rank", _g("SELECT CASE frame WHEN 2 THEN -1 ELSE frame END AS frame, CAST(k AS INTEGER) AS position, codon, count(*) AS n FROM cd GROUP BY ALL", _CODONS_SQL % "regexp_replace(mrna_seq, 'A+$', '')"))
def _(spark, d):
    return scan.codon_rank(genome(spark, d))


@query("a33_composition", _g("SELECT CAST((p - 1) % 3 AS INTEGER) AS slot, substr(mrna_seq, p, 1) AS base, count(*) AS n FROM genome, generate_series(1, length(mrna_seq)) AS t(p) GROUP BY ALL"))
def _(spark, d):
    return scan.composition(genome(spark, d))


@query("a27_stop_distances", _g("SELECT frame, CAST(distance AS INTEGER) AS distance, count(*) AS n FROM (SELECT frame, k - lag(k) OVER (PARTITION BY id, frame ORDER BY k) AS distance FROM cd WHERE codon IN ('TAA', 'TAG', 'TGA')) WHERE distance IS NOT NULL GROUP BY ALL", _CODONS_SQL % "mrna_seq"))
def _(spark, d):
    return scan.stop_distances(genome(spark, d))


@query("f5_text_search", "SELECT doc_id AS id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), 'the') AND NOT list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), 'that') AND contains(lower(text), 'of the')")
def _(spark, d):
    return stats.text_search(genome(spark, d), '+the -that +"of the"').select("id")


@query("a37_species_list", _g("SELECT species, count(*) AS genes FROM genome GROUP BY species"))
def _(spark, d):
    return genome(spark, d).groupBy("species").agg(F.count("*").alias("genes"))


@query("a9_zscore_counts", _m("SELECT species, mfe_method, count(*) AS n, CAST(sum(CASE WHEN zscore < -2 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM points WHERE mfe <= 10 GROUP BY ALL"))
def _(spark, d):
    z = stats.zscores(mfe(spark, d))
    return z.groupBy("species", "mfe_method").agg(F.count("*").alias("n"), F.sum(((F.col("mfe") - F.col("mfe_mean")) / F.col("mfe_sd") < -2).cast("long")).alias("low"))


def _stats_sql() -> str:
    cols = ["round(min(mfe), 4) AS min_mfe", "round(max(mfe), 4) AS max_mfe", "round(avg(zscore), 4) AS avg_zscore", "round(stddev_pop(zscore), 4) AS stddev_zscore"]
    for name, cond in (("all", "true"), ("noknot", "NOT knotp"), ("knotted", "knotp")):
        cols += [f"count(mfe) FILTER (WHERE {cond}) AS num_{name}"]
        cols += [f"round({f}({c}) FILTER (WHERE {cond}), 4) AS {n}_{c}_{name}" for c in ("mfe", "pairs") for f, n in (("avg", "avg"), ("stddev_pop", "stddev"))]
    keys = "species, seqlength, mfe_method"
    genes = ["count(DISTINCT accession) AS genes_hits"]
    for k in (1, 2):
        m, z = f"mfe < am - {k} * sm", f"zscore < az - {k} * sz"
        for name, cond in (("mfe", m), ("z", z), ("both", f"{m} AND {z}")):
            genes += [f"count(DISTINCT accession) FILTER (WHERE {cond}) AS genes_{k}{name}", f"count(DISTINCT accession) FILTER (WHERE {cond} AND knotp) AS genes_{k}{name}_knotted"]
    return _m(f"""SELECT * FROM (SELECT {keys}, {', '.join(cols)} FROM points GROUP BY {keys}) JOIN (SELECT {keys}, {', '.join(genes)} FROM (SELECT *, avg(mfe) OVER w AS am, stddev_pop(mfe) OVER w AS sm, avg(zscore) OVER w AS az, stddev_pop(zscore) OVER w AS sz FROM points WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys}) USING ({keys})""")


@query("a1_species_stats", _stats_sql())
def _(spark, d):
    return stats.rounded(stats.species_stats(points(spark, d)))


@query("a2_index_stats", _m("SELECT coalesce(g.species, m.species) AS species, coalesce(num_genome, 0) AS num_genome, coalesce(num_mfe, 0) AS num_mfe, coalesce(num_knotted, 0) AS num_knotted FROM (SELECT 'sp' || (p_partkey % 5) AS species, count(*) AS num_genome FROM part GROUP BY 1) g FULL JOIN (SELECT species, count(*) AS num_mfe, count(DISTINCT CASE WHEN knotp THEN accession END) AS num_knotted FROM mfe GROUP BY species) m USING (species)"))
def _(spark, d):
    genes = read(spark, d, "part").select(F.concat(F.lit("sp"), F.col("p_partkey") % 5).alias("species"))
    return stats.index_stats(genes, mfe(spark, d))


@query("a4_site_counts", _m("SELECT accession, count(DISTINCT start) AS sites, count(DISTINCT id) AS structures FROM mfe GROUP BY accession"))
def _(spark, d):
    return stats.site_counts(mfe(spark, d))


@query("a10_cloud_density", _m("SELECT CAST(floor(mfe * 10) AS BIGINT) AS mfe10, CAST(floor(zscore * 100) AS BIGINT) AS z100, count(*) AS n, CAST(sum(CAST(knotp AS INTEGER)) AS BIGINT) AS knotted, count(DISTINCT accession) AS genes FROM points WHERE mfe > -80 AND mfe < 5 AND zscore > -10 AND zscore < 10 GROUP BY 1, 2"))
def _(spark, d):
    return stats.cloud_density(stats.weed(points(spark, d)))


@query("a11_cloud_averages", _m("SELECT species, round(avg(mfe), 4) AS avg_mfe, round(stddev_pop(mfe), 4) AS sd_mfe, round(avg(zscore), 4) AS avg_z, round(stddev_pop(zscore), 4) AS sd_z FROM points GROUP BY species"))
def _(spark, d):
    return stats.rounded(stats.cloud_averages(points(spark, d)))


def _hist_sql(column: str, per: int) -> str:
    return _m(f"SELECT bin, coalesce(unknotted, 0) AS unknotted, coalesce(knotted, 0) AS knotted FROM (SELECT CAST(unnest(generate_series(min(bin), max(bin))) AS BIGINT) AS bin FROM b) LEFT JOIN b USING (bin)", f"b AS (SELECT CAST(floor({column} * {per}) AS BIGINT) AS bin, CAST(sum(CAST(NOT knotp AS INTEGER)) AS BIGINT) AS unknotted, CAST(sum(CAST(knotp AS INTEGER)) AS BIGINT) AS knotted FROM points GROUP BY 1)")


@query("a12_mfe_distribution", _hist_sql("mfe", 3))
def _(spark, d):
    return stats.distribution(points(spark, d), "mfe", 3)


@query("a13_z_distribution", _hist_sql("zscore", 10))
def _(spark, d):
    return stats.distribution(points(spark, d), "zscore", 10)


@query("a14_significant_bars", _m("SELECT mfe_method, count(*) AS total, CAST(sum(CASE WHEN mfe <= am - sm AND zscore <= az - sz THEN 1 ELSE 0 END) AS BIGINT) AS significant, round(100.0 * sum(CASE WHEN mfe <= am - sm AND zscore <= az - sz THEN 1 ELSE 0 END) / count(*), 2) AS percent FROM points JOIN (SELECT species, avg(mfe) AS am, stddev_pop(mfe) AS sm, avg(zscore) AS az, stddev_pop(zscore) AS sz FROM points GROUP BY species) USING (species) GROUP BY mfe_method"))
def _(spark, d):
    return stats.significant_by(points(spark, d), "mfe_method")


@query("a34_mfe_range", _m("SELECT mfe_method, round(min(mfe), 4) AS lo, round(max(mfe), 4) AS hi FROM mfe GROUP BY mfe_method"))
def _(spark, d):
    return mfe(spark, d).groupBy("mfe_method").agg(F.round(F.min("mfe"), 4).alias("lo"), F.round(F.max("mfe"), 4).alias("hi"))


@query("a38_species_method_summary", _m("SELECT species, mfe_method, count(*) AS folds, CAST(sum(CAST(knotp AS INTEGER)) AS BIGINT) AS knotted FROM mfe GROUP BY ALL"))
def _(spark, d):
    return mfe(spark, d).groupBy("species", "mfe_method").agg(F.count("*").alias("folds"), F.sum(F.col("knotp").cast("long")).alias("knotted"))


@query("a31_facet_histogram", _m("SELECT species, mfe_method, CAST(least(49, floor((mfe - lo) / (hi - lo) * 50)) AS INTEGER) AS bin, count(*) AS n, round(100.0 * count(*) / any_value(total), 3) AS percent FROM (SELECT *, min(mfe) OVER w AS lo, max(mfe) OVER w AS hi, count(*) OVER w AS total FROM points WINDOW w AS (PARTITION BY species, mfe_method)) GROUP BY ALL"))
def _(spark, d):
    return stats.facet_histogram(points(spark, d), ["species", "mfe_method"])


@query("a35_missing_methods", _m("SELECT a.accession, m.mfe_method FROM (SELECT DISTINCT accession FROM mfe) a, (SELECT DISTINCT mfe_method FROM mfe) m WHERE NOT EXISTS (SELECT 1 FROM mfe x WHERE x.accession = a.accession AND x.mfe_method = m.mfe_method)"))
def _(spark, d):
    m = mfe(spark, d).select("accession", "mfe_method").distinct()
    grid = m.select("accession").distinct().withColumn("mfe_method", F.explode(F.array(*[F.lit(f"method{k}") for k in range(3)])))
    return stats.pending(grid, m, ["accession", "mfe_method"])


@query("a36_incomplete_sites", _m("SELECT accession, start, count(*) AS n FROM mfe GROUP BY ALL HAVING count(*) < 9"))
def _(spark, d):
    return mfe(spark, d).groupBy("accession", "start").agg(F.count("*").alias("n")).where("n < 9")


@query("w1_first_prediction", _m("SELECT accession, start, seqlength, mfe_method, min(id) AS id FROM mfe GROUP BY ALL"))
def _(spark, d):
    keys = ["accession", "start", "seqlength", "mfe_method"]
    return stats.first_per(mfe(spark, d), keys).select(*keys, "id")


@query("w2_duplicate_groups", _m("SELECT accession, mfe_method, seqlength, count(*) AS n, min(id) AS keep FROM mfe GROUP BY ALL HAVING count(*) > 1"))
def _(spark, d):
    return stats.duplicate_groups(mfe(spark, d), ["accession", "mfe_method", "seqlength"])


@query("w9_score_bands", _m("SELECT species, band, count(*) AS n FROM (SELECT species, CAST(floor(coalesce(sum(c) OVER (PARTITION BY species ORDER BY pairs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 10 / sum(c) OVER (PARTITION BY species)) AS INTEGER) AS band, c, pairs FROM (SELECT species, pairs, count(*) AS c FROM mfe GROUP BY ALL)), generate_series(1, c) GROUP BY ALL"))
def _(spark, d):
    return stats.score_bands(mfe(spark, d).select("species", "pairs"), "pairs").groupBy("species", "band").agg(F.count("*").alias("n"))


@query("u1_reconnect", _m("SELECT b.id, m.mfe_id FROM (SELECT * FROM mfe WHERE id % 7 <> 0) b JOIN (SELECT accession, start, seqlength, mfe_method, min(id) AS mfe_id FROM mfe GROUP BY ALL) m USING (accession, start, seqlength, mfe_method)"))
def _(spark, d):
    m = mfe(spark, d)
    return stats.reconnect(m.where("id % 7 <> 0").withColumn("mfe_id", F.lit(None).cast("long")), m).select("id", "mfe_id")


@query("u7_pending", "SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    done = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return stats.pending(read(spark, d, "part").select("p_partkey").distinct(), done, ["p_partkey"])


@query("j2_genes_on_both_axes", _m("SELECT DISTINCT accession FROM points p WHERE mfe < -60 AND EXISTS (SELECT 1 FROM points q WHERE q.accession = p.accession AND q.zscore < -3)"))
def _(spark, d):
    p = points(spark, d)
    return p.where("mfe < -60").select("accession").distinct().join(p.where("zscore < -3").select("accession").distinct(), "accession", "left_semi")


@query("j6_snp_windows", """WITH w AS (SELECT DISTINCT l_partkey % 200 AS gene, 1 + 3 * (l_orderkey % 300) AS start FROM lineitem), s AS (SELECT o_orderkey AS id, o_orderkey % 200 AS gene, 1 + o_custkey % 1000 AS pos FROM orders)
SELECT s.id, min(CASE WHEN pos <= start + 6 THEN 's' ELSE 'w' END) AS class, count(*) AS windows FROM s JOIN w ON s.gene = w.gene AND pos BETWEEN start AND start + 106 GROUP BY s.id""")
def _(spark, d):
    w = read(spark, d, "lineitem").select((F.col("l_partkey") % 200).alias("gene"), (1 + 3 * (F.col("l_orderkey") % 300)).alias("start")).distinct()
    s = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 200).alias("gene"), (1 + F.col("o_custkey") % 1000).alias("at"), (1 + F.col("o_custkey") % 1000).alias("at_end"))
    spans = w.select("gene", "start", (F.col("start") - 1).alias("lo"), (F.col("start") + 107).alias("hi"))
    hits = stats.binned_range_join(s, spans, "gene", 128)
    return hits.groupBy("id").agg(F.min(F.when(F.col("at") <= F.col("start") + 6, "s").otherwise("w")).alias("class"), F.count("*").alias("windows"))


@query("j8_reads_in_genes", """WITH r AS (SELECT user_id % 16 AS chromosome, 1 + CAST(floor(value * 7) AS BIGINT) AS pos FROM events WHERE value IS NOT NULL), g AS (SELECT p_partkey AS gene, p_partkey % 16 AS chromosome, CAST(floor(p_retailprice / 4) AS BIGINT) AS lo, CAST(floor(p_retailprice / 4) AS BIGINT) + p_size * 10 AS hi FROM part)
SELECT gene, count(*) AS reads FROM r JOIN g ON r.chromosome = g.chromosome AND lo < pos AND pos + 28 < hi GROUP BY gene""")
def _(spark, d):
    r = read(spark, d, "events").where("value is not null").select((F.col("user_id") % 16).alias("chromosome"), (1 + F.floor(F.col("value") * 7)).alias("at"))
    lo = F.floor(F.col("p_retailprice") / 4)
    g = read(spark, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") % 16).alias("chromosome"), lo.alias("lo"), (lo + F.col("p_size") * 10).alias("hi"))
    return stats.contained_counts(r, g, "chromosome", "gene", 28).withColumnRenamed("n", "reads")


@query("a20_frame_depth", "SELECT event_type, CAST((1 + CAST(floor(value * 7) AS BIGINT) + 15) % 3 AS INTEGER) AS frame, count(*) AS n FROM events WHERE value >= 0 GROUP BY ALL")
def _(spark, d):
    at = 1 + F.floor(F.col("value") * 7)
    return read(spark, d, "events").where("value >= 0").groupBy("event_type", F.pmod(at + 15, F.lit(3)).cast("int").alias("frame")).agg(F.count("*").alias("n"))


@query("a25_expression_stats", "SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, round(var_pop(value), 4) AS var, round(covar_pop(value, user_id), 4) AS cov, round(corr(value, user_id), 4) AS cor FROM events GROUP BY event_type")
def _(spark, d):
    v, u = F.col("value"), F.col("user_id")
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("sd"), F.round(F.var_pop(v), 4).alias("var"), F.round(F.covar_pop(v, u), 4).alias("cov"), F.round(F.corr(v, u), 4).alias("cor"))


@query("a32_null_census", "SELECT column_name AS \"column\", n AS blank FROM (SELECT count(CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 1 END) AS p_name, count(CASE WHEN p_brand IS NULL OR trim(p_brand) = '' THEN 1 END) AS p_brand, count(CASE WHEN p_size IS NULL THEN 1 END) AS p_size FROM part) UNPIVOT (n FOR column_name IN (p_name, p_brand, p_size))")
def _(spark, d):
    return stats.null_census(read(spark, d, "part").select("p_name", "p_brand", "p_size"))


_STRUCT = "concat(repeat('.', cast(id % 5 as int)), repeat('(', cast(2 + id % 7 as int)), repeat('.', 4), repeat(')', cast(2 + id % 7 as int)), '..', '(((...)))')"
_PAIRS_SQL = """s AS (SELECT doc_id AS id, repeat('.', CAST(doc_id % 5 AS INTEGER)) || repeat('(', CAST(2 + doc_id % 7 AS INTEGER)) || '....' || repeat(')', CAST(2 + doc_id % 7 AS INTEGER)) || '..(((...)))' AS parens FROM documents),
b AS (SELECT id, p, substr(parens, p + 1, 1) AS c FROM s, generate_series(0, 60) AS t(p) WHERE p < length(parens) AND substr(parens, p + 1, 1) <> '.'),
d AS (SELECT id, p, c, sum(CASE WHEN c = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY p) + CASE WHEN c = ')' THEN 1 ELSE 0 END AS depth FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY id, c, depth ORDER BY p) AS n FROM d),
e AS (SELECT o.id, CAST(o.p AS INTEGER) AS i, CAST(z.p AS INTEGER) AS j FROM k o JOIN k z ON o.id = z.id AND o.depth = z.depth AND o.n = z.n AND o.c = '(' AND z.c = ')')"""


def _structures(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id")).withColumn("parens", F.expr(_STRUCT))


@query("t1_parens_to_pairs", f"WITH {_PAIRS_SQL} SELECT id, i, j FROM e")
def _(spark, d):
    return structure.parens_to_pairs(_structures(spark, d))


@query("t13_pair_span", f"WITH {_PAIRS_SQL} SELECT id, max(j - i) AS span, count(*) AS pairs FROM e GROUP BY id")
def _(spark, d):
    return structure.max_pair_span(structure.parens_to_pairs(_structures(spark, d)))


@query("t12_stem_sizes", f"WITH {_PAIRS_SQL}, n AS (SELECT *, CASE WHEN i - lag(i) OVER w <= 12 AND lag(j) OVER w - j BETWEEN 1 AND 12 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY id ORDER BY i)) SELECT id, stem, count(*) AS pairs FROM (SELECT id, CAST(sum(new) OVER (PARTITION BY id ORDER BY i) AS BIGINT) AS stem FROM n) GROUP BY ALL")
def _(spark, d):
    return structure.stem_sizes(structure.assign_stems(structure.parens_to_pairs(_structures(spark, d))))


@query("t5_barcode", "SELECT doc_id AS id, '1122' AS barcode FROM documents")
def _(spark, d):
    return structure.barcode(structure.assign_stems(structure.parens_to_pairs(_structures(spark, d))))


@query("t6_knotted", f"WITH {_PAIRS_SQL}, x AS (SELECT id, i, j FROM e UNION ALL SELECT id, max(i) + 3, max(j) + 20 FROM e WHERE id % 3 = 0 GROUP BY id) SELECT DISTINCT a.id FROM x a JOIN x b ON a.id = b.id AND a.i < b.i AND b.i < a.j AND a.j < b.j")
def _(spark, d):
    e = structure.parens_to_pairs(_structures(spark, d))
    return structure.knotted(e.union(e.where("id % 3 = 0").groupBy("id").agg((F.max("i") + 3).alias("i"), (F.max("j") + 20).alias("j"))))
