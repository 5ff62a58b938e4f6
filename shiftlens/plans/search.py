"""Queries on similar sequences, microRNA targets, null models that keep doublets, and folders of the caller, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import nulls, scan, similar
from shiftlens.plans.registry import _KEY, _ORDER, _STACKED, _g, query
from shiftlens.plans.signals import _GENOME_LETTERS, _windows
from shiftlens.sources.fixtures import SITES_SQL, genome, read

_KMERS = """cut AS (SELECT id, unnest(regexp_extract_all(mrna_seq, '.{1,256}')) AS part, unnest(range((length(mrna_seq) + 255) // 256)) AS k FROM genome),
piece AS (SELECT id, k, part || coalesce(substr(lead(part) OVER (PARTITION BY id ORDER BY k), 1, 11), '') AS piece FROM cut),
km AS (SELECT id, 256 * k + p AS p, substr(piece, p + 1, 12) AS word FROM piece, generate_series(0, 255) AS t(p) WHERE p + 12 <= length(piece)),
wc AS (SELECT id, word, count(*) AS n FROM km GROUP BY ALL),
pairs AS (SELECT q.id AS q, t.id AS t, count(*) AS words, sum(q.n * t.n) AS places,
  sum(least(q.n, t.n) * 5 * length(regexp_replace(word, '[^ACGT]', '', 'g'))) AS score FROM wc q JOIN wc t USING (word) WHERE q.id % 20 = 0 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS rank FROM pairs QUALIFY rank <= 10),
hits AS (SELECT q, t, b.p - a.p AS d, a.p AS a FROM best JOIN km a ON a.id = q JOIN km b ON b.id = t AND b.word = a.word),
runs AS (SELECT q, t, d, min(a) AS a, count(*) AS n FROM (SELECT *, a - row_number() OVER (PARTITION BY q, t, d ORDER BY a) AS run FROM hits) GROUP BY q, t, d, run),
longest AS (SELECT *, row_number() OVER (PARTITION BY q, t ORDER BY n DESC, d, a) AS r FROM runs QUALIFY r = 1)"""


@query(
    "j12_similar_sequences",
    _g(
        """SELECT q, t, words, CAST(places AS BIGINT) AS places, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank,
CAST(d AS INTEGER) AS diagonal, CAST(a AS INTEGER) AS q_start, CAST(n + 11 AS INTEGER) AS length FROM best JOIN longest USING (q, t)""",
        _KMERS,
    ),
)
def _(spark, d):
    w = genome(spark, d).select("id", F.col("mrna_seq").alias("sequence"))
    return similar.similar_sequences(w.where("id % 20 = 0"), w)


_ENERGY = "CASE WHEN {0} IN ('GC', 'CG') THEN -3 WHEN {0} IN ('AT', 'TA') THEN -2 WHEN {0} IN ('GT', 'TG') THEN -1 ELSE 1 END"
_TARGETS = f"""v AS (SELECT id || ':' || start AS id, substr(mrna_seq, start + 7, 100) AS w FROM sites WHERE length(mrna_seq) >= start + 106),
mi AS (SELECT p_partkey AS mirna, {_GENOME_LETTERS} AS m FROM part),
hit AS (SELECT mirna, m, id, w, CAST(k AS INTEGER) AS spot FROM v, generate_series(0, 93) AS t(k), (SELECT *, reverse(translate(substr(m, 2, 7), 'ACGT', 'TGCA')) AS word FROM mi)
  WHERE length(m) >= 8 AND word = substr(w, k + 1, 7)),
step AS (SELECT mirna, id, spot, k, sum({_ENERGY.format("substr(m, CAST(8 + k AS INTEGER), 1) || substr(w, CAST(spot + 1 - k AS INTEGER), 1)")})
    OVER (PARTITION BY mirna, id, spot ORDER BY k) AS now FROM hit, generate_series(1, 60) AS t(k) WHERE 8 + k <= length(m) AND spot + 1 - k >= 1),
low AS (SELECT *, least(0, min(now) OVER (PARTITION BY mirna, id, spot ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS before FROM step),
stop AS (SELECT mirna, id, spot, min(k) FILTER (WHERE now > coalesce(before, 0) + 4) AS k FROM low GROUP BY ALL),
three AS (SELECT mirna, id, spot, least(0, min(now)) AS e FROM step JOIN stop s USING (mirna, id, spot) WHERE s.k IS NULL OR step.k < s.k GROUP BY ALL),
scored AS (SELECT mirna, id, spot, -2 * 7 - length(regexp_replace(substr(m, 2, 7), '[^CG]', '', 'g')) + coalesce(e, 0)
  + CASE WHEN spot + 8 <= length(w) THEN least(0, {_ENERGY.format("substr(m, 1, 1) || substr(w, spot + 8, 1)")}) ELSE 0 END AS energy FROM hit LEFT JOIN three USING (mirna, id, spot))"""


def _mirnas(spark, d):
    letters = F.translate(F.regexp_replace(F.lower("p_name"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTAACTTGCTGATCAGTCATGCAT")
    return read(spark, d, "part").select(F.col("p_partkey").alias("mirna"), letters.alias("sequence"))


def _behind(spark, d):
    found = scan.keep_coding(scan.find_slipsites(genome(spark, d), (100,)), do_utr=True)
    return found.select(F.concat_ws(":", "id", "start").alias("id"), "sequence")


@query("j14_scored_targets", _g("SELECT mirna, id, spot AS at, CAST(energy AS INTEGER) AS energy FROM scored WHERE energy <= -22", SITES_SQL, _TARGETS))
def _(spark, d):
    return similar.scored_targets(_mirnas(spark, d), _behind(spark, d))


@query("f8_reported_targets", _g("SELECT mirna, count(*) AS hits, CAST(min(energy) AS INTEGER) AS best FROM scored WHERE energy <= -25 GROUP BY mirna", SITES_SQL, _TARGETS))
def _(spark, d):
    return similar.reported_targets(_mirnas(spark, d), _behind(spark, d), -25)


_LENGTHS = (100, 75, 50)
_FULL = f"""v AS (SELECT id, start, CAST(l AS INTEGER) AS seqlength, substr(mrna_seq, start + 7, l) AS w FROM sites, (VALUES (100), (75), (50)) AS t(l) WHERE length(mrna_seq) >= start + 6 + l),
h AS (SELECT id, start, seqlength, w, iteration, CAST(seqlength AS BIGINT) AS n, {_KEY.format(more="'|' || seqlength ||")} AS h
  FROM v, (SELECT CAST(unnest(generate_series(1, 100)) AS INTEGER) AS iteration)),
n AS (SELECT id, start, seqlength, iteration, array_to_string(list_transform({_ORDER}, lambda q: substr(w, CAST(q + 1 AS INTEGER), 1)), '') AS s FROM h),
e AS (SELECT id, start, seqlength, {_STACKED} AS e, (length(s) - length(replace(s, 'GC', ''))) // 2 AS pairs FROM n)"""


@query(
    "g4_bootstrap_full",
    _g(
        """SELECT id, start, seqlength, count(*) AS iterations, round(avg(e), 2) AS mfe_mean, round(stddev_samp(e), 2) AS mfe_sd, round(stddev_samp(e) / sqrt(count(*)), 2) AS mfe_se,
round(avg(pairs), 2) AS pairs_mean, round(stddev_samp(pairs), 2) AS pairs_sd, round(stddev_samp(pairs) / sqrt(count(*)), 2) AS pairs_se,
string_agg(CAST(e AS VARCHAR), ' ' ORDER BY e) AS mfe_values FROM e GROUP BY ALL""",
        SITES_SQL, _FULL,
    ),
)
def _(spark, d):
    windows = scan.keep_coding(scan.find_slipsites(genome(spark, d), _LENGTHS), do_utr=True).select("id", "start", "seqlength", "sequence")
    return nulls.bootstrap_stacks(windows, ["id", "start", "seqlength"], {pair: round(v * 100) for pair, v in S.STACK.items()})


_DOUBLETS = [a + b for a in "ACGT" for b in "ACGT"]


@query(
    "r8_kept_doublets",
    _g(
        f"""SELECT id, start, CAST(i AS INTEGER) AS iteration, substr(w, 1, 1) AS first, substr(w, 100, 1) AS last, {', '.join(
            f"CAST(len(list_filter(range(1, 100), lambda q: substr(w, CAST(q AS INTEGER), 2) = '{x}')) AS INTEGER) AS {x.lower()}_n" for x in _DOUBLETS)}
FROM (SELECT id, start, substr(mrna_seq, start + 7, 100) AS w FROM sites WHERE length(mrna_seq) >= start + 106), generate_series(1, 10) AS t(i)""",
        SITES_SQL,
    ),
)
def _(spark, d):
    """Counts of the shuffled windows; the SQL counts the windows as they were."""
    windows = scan.keep_coding(scan.find_slipsites(genome(spark, d), (100,)), do_utr=True).select("id", "start", "sequence")
    rows = nulls.fan_out(windows, 10).withColumn("s", nulls.kept_doublets(F.col("sequence"), F.lit(7), F.col("id"), F.col("start"), F.col("iteration")))
    counts = [F.get("n", F.lit(k)).alias(f"{x.lower()}_n") for k, x in enumerate(_DOUBLETS)]
    return rows.withColumn("n", nulls.doublet_counts(F.col("s"))).select("id", "start", "iteration", F.substring("s", 1, 1).alias("first"), F.right("s", F.lit(1)).alias("last"), *counts)


def nested_pairs(seq: str) -> tuple[float, str]:
    """A small folder: most nested pairs of a window that begins with a base other than A, with three bases inside a pair at least."""
    if seq.startswith("A"):
        raise ValueError("no fold")
    runs = {"G": "CT", "C": "G", "A": "T", "T": "AG"}
    open_, out = [], ["."] * len(seq)
    for i, c in enumerate(seq):  # closes the latest open base that it pairs with
        if open_ and i - open_[-1] > 3 and seq[open_[-1]] in runs[c]:
            out[open_[-1]], out[i] = "(", ")"
            open_.pop()
        elif c in "GT":
            open_.append(i)
    pairs = out.count("(")
    return -float(pairs), "".join(out)


@query("g1_folder", _g("""SELECT id, start, CAST(CASE WHEN w LIKE 'A%' THEN NULL WHEN w LIKE 'C%' THEN -99 ELSE 1 END AS DOUBLE) AS known, CASE WHEN w LIKE 'A%' THEN 'ValueError: no fold' END AS error
FROM (SELECT id, start, substr(mrna_seq, start + 7, 50) AS w FROM sites WHERE length(mrna_seq) >= start + 56)""", SITES_SQL))
def _(spark, d):
    windows = _windows(spark, d).select("id", "start", "sequence")
    known = windows.where("sequence like 'C%'").select("sequence", F.lit(-99.0).alias("mfe"), F.lit("").alias("parens")).distinct()
    done = nulls.fold_with(windows, nested_pairs, known)
    sound = F.when(F.col("error").isNull() & (F.col("mfe") == -F.length(F.regexp_replace("parens", "[^(]", ""))), 1.0)
    return done.select("id", "start", F.when(F.col("mfe") == -99.0, F.col("mfe")).otherwise(sound).alias("known"), "error")
