"""Queries on written tables, streams run to their end, links, facets and series, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlens.operators import points as P
from shiftlens.operators import scan, signals, stats
from shiftlens.plans.registry import ORACLES, _g, _m, query
from shiftlens.sources import readers
from shiftlens.sources.fixtures import SITES_SQL, genome, mfe, points, read
from shiftlens.sources.work import work_dir
from shiftlens.streaming import imports

_SETS = [["species"], ["mfe_method"], ["seqlength"], ["knotp"], ["species", "mfe_method", "seqlength", "knotp"]]


def _facets() -> str:
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
    one = lambda cols: f"""SELECT '{'|'.join(cols)}' AS facet, {" || '|' || ".join(text(c) for c in cols)} AS value, mfe FROM points"""
    return " UNION ALL ".join(one(cols) for cols in _SETS)


@query(
    "a31_facets",
    _m(
        """SELECT facet, value, bin, n, round(100.0 * n / total, 3) AS percent, floor(sum(n) OVER (PARTITION BY facet, value ORDER BY bin) * 10000 / total) / 10000 AS score
FROM (SELECT facet, value, total, CAST(CASE WHEN hi > lo THEN least(49, floor((mfe - lo) / (hi - lo) * 50)) ELSE 0 END AS INTEGER) AS bin, count(*) AS n
  FROM fr JOIN ends USING (facet, value) GROUP BY ALL)""",
        f"fr AS ({_facets()})", "ends AS (SELECT facet, value, min(mfe) AS lo, max(mfe) AS hi, count(*) AS total FROM fr GROUP BY ALL)",
    ),
)
def _(spark, d):
    return stats.facet_histograms(points(spark, d), _SETS)


_BOOT = """bt AS (SELECT id * 2 + k AS id, accession, start, seqlength, mfe_method, CASE WHEN id % 3 = 0 THEN id ELSE -1 END AS mfe_id
  FROM mfe, (VALUES (0), (1)) AS t(k) WHERE k = 0 OR id % 11 = 0),
kn AS (SELECT * FROM mfe WHERE id % 7 <> 0),
best AS (SELECT accession, start, seqlength, mfe_method, min(id) AS m FROM kn GROUP BY ALL),
ones AS (SELECT accession, start, seqlength, mfe_method, min(id) AS f FROM bt GROUP BY ALL),
ruled AS (SELECT b.id, coalesce(m, mfe_id) AS mfe_id, CASE WHEN m IS NULL THEN 'orphan' WHEN id > f THEN 'duplicate' WHEN mfe_id = m THEN 'kept' ELSE 'relinked' END AS verdict
  FROM bt b LEFT JOIN best USING (accession, start, seqlength, mfe_method) LEFT JOIN ones USING (accession, start, seqlength, mfe_method))"""


def _linked(spark, d):
    m = mfe(spark, d)
    small = m.select("id", "accession", "start", "seqlength", "mfe_method").withColumn("id", F.col("id") % (1 << 60))
    boot = small.withColumn("k", F.explode(F.when(F.col("id") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    boot = boot.withColumn("mfe_id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1))).withColumn("id", F.col("id") * 2 + F.col("k")).drop("k")
    return stats.audit_links(boot, small.where("id % 7 <> 0"))


@query("u1_audit_links", _m("SELECT id, mfe_id, verdict FROM ruled", _BOOT))
def _(spark, d):
    return _linked(spark, d)[0].select("id", "mfe_id", "verdict")


@query("u1_repeated_predictions", _m("SELECT k.id FROM kn k JOIN best USING (accession, start, seqlength, mfe_method) WHERE k.id > m", _BOOT))
def _(spark, d):
    return _linked(spark, d)[1].select("id")


@query(
    "u4_relink",
    _m(
        """SELECT l.id, m.least.id AS mfe_id, m.least.species AS species, m.least.seqlength AS seqlength, CASE WHEN m.least IS NULL THEN 'deleted' ELSE 'linked' END AS verdict
FROM lost l LEFT JOIN (SELECT accession, mfe_method, CAST(round(mfe * 10) AS BIGINT) AS e, min({'id': id, 'species': species, 'seqlength': seqlength}) AS least FROM mfe GROUP BY ALL) m
  ON m.accession = l.accession AND m.mfe_method = l.mfe_method AND m.e = l.e""",
        """lost AS (SELECT id, accession, mfe_method, CAST(round((mfe_sd * zscore + mfe_mean) * 10) AS BIGINT) AS e FROM
  (SELECT id, accession, mfe_method, 1.5 AS mfe_sd, (mfe + CASE WHEN id % 5 = 0 THEN 1000 ELSE 0 END - mfe_mean) / 1.5 AS zscore, mfe_mean FROM mfe))""",
    ),
)
def _(spark, d):
    m = mfe(spark, d)
    shift = F.when(F.col("id") % 5 == 0, 1000).otherwise(0)
    boot = m.select("id", "accession", "mfe_method", F.lit(1.5).alias("mfe_sd"), ((F.col("mfe") + shift - F.col("mfe_mean")) / 1.5).alias("zscore"), "mfe_mean")
    return P.relink(boot, m).select("id", "mfe_id", "species", "seqlength", "verdict")


_DATA = "'[' || string_agg('[' || CAST(CAST(start AS DOUBLE) AS VARCHAR) || ',' || CAST(e AS VARCHAR) || ']', ',' ORDER BY start, e) || ']'"


@query(
    "k6_series_pieces",
    _m(
        f"""SELECT species, mfe_method, CAST((r - 1) // 1000 AS INTEGER) AS piece, CAST(min(start) AS DOUBLE) AS first_x, CAST(max(start) AS DOUBLE) AS last_x,
CAST(count(*) AS INTEGER) AS points, {_DATA} AS data FROM (SELECT *, row_number() OVER (PARTITION BY species, mfe_method ORDER BY start, e) AS r
FROM (SELECT species, mfe_method, start, floor(mfe * 1000) / 1000.0 AS e FROM mfe)) GROUP BY species, mfe_method, piece"""
    ),
)
def _(spark, d):
    rows = mfe(spark, d).select("species", "mfe_method", "start", (F.floor(F.col("mfe") * 1000) / 1000.0).alias("e"))
    return signals.series_pieces(rows, "species", "mfe_method", "start", "e")


ORACLES["k6_series_json"] = _m(
    """SELECT species, '[' || string_agg('{"label":"' || mfe_method || '","data":[' || data || ']}', ',' ORDER BY mfe_method) || ']' AS series FROM
(SELECT species, mfe_method, string_agg('[' || CAST(CAST(pairs AS DOUBLE) AS VARCHAR) || ',' || CAST(e AS VARCHAR) || ']', ',' ORDER BY pairs) AS data FROM
  (SELECT species, mfe_method, pairs, round(avg(mfe), 3) AS e FROM mfe GROUP BY ALL) GROUP BY ALL) GROUP BY species"""
)

_WRITTEN = "SELECT species, count(*) AS n, CAST(sum(pairs) AS BIGINT) AS pairs FROM (SELECT species, CASE WHEN species = 'sp1' THEN pairs + 1000 ELSE pairs END AS pairs, id FROM mfe WHERE species <> 'sp1' OR id % 2 = 0) "


def _slices(spark, d):
    path = work_dir(spark, "slices")
    table = mfe(spark, d).select("id", "species", "pairs")
    readers.write_by_species(table, path)
    fresh = table.where("species = 'sp1' and id % 2 = 0").withColumn("pairs", F.col("pairs") + 1000)
    P.replace_slice(fresh.withColumn("species_key", readers.S.species_key(F.col("species"))), path, "species_key")
    return path


@query("k10_replace_slice", _m(_WRITTEN + "GROUP BY species"))
def _(spark, d):
    return spark.read.parquet(_slices(spark, d)).groupBy("species").agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs"))


@query("s12_scan_species", _m(_WRITTEN + "WHERE species = 'sp2' GROUP BY species"))
def _(spark, d):
    return readers.scan_species(spark, _slices(spark, d), "sp2").groupBy("species").agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs"))


@query("k3_dump_table", _m("SELECT id, species, seqlength, pairs FROM mfe WHERE species = 'sp3'"))
def _(spark, d):
    path = work_dir(spark, "dump")
    P.dump_table(mfe(spark, d).select("id", "species", "seqlength", "pairs"), path, "\t", "sp3")
    return spark.read.option("header", True).option("sep", "\t").schema("id long, species string, seqlength int, pairs int").csv(path)


@query("k13_copy_columns", _m("SELECT id, accession AS gene, pairs AS basepairs FROM mfe"))
def _(spark, d):
    path = work_dir(spark, "copy")
    P.copy_columns(mfe(spark, d), {"id": "id", "accession": "gene", "pairs": "basepairs"}).write.parquet(path)
    return spark.read.parquet(path)


@query("u8_repair_knots", _m("SELECT id, pairs % 4 = 0 AS knotp FROM mfe"))
def _(spark, d):
    m = mfe(spark, d)
    return P.repair_knots(m, m.where("pairs % 4 = 0").select("id").union(m.where("pairs % 8 = 0").select("id"))).select("id", "knotp")


def _ended(writer) -> None:
    """Run a stream over what is there and wait for its end."""
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    if running.exception():
        raise running.exception()


def _stream(spark, d: str, name: str):
    """A table as a stream, whether it is one file or a folder of files."""
    return spark.readStream.schema(read(spark, d, name).schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/{name}.parque[t]")


@query("m1_import", _g("SELECT accession, count(*) AS windows FROM sites WHERE length(mrna_seq) >= start + 106 GROUP BY accession", SITES_SQL))
def _(spark, d):
    path, log = work_dir(spark, "imported"), work_dir(spark, "log")
    _ended(imports.import_stream(_stream(spark, d, "documents").selectExpr("doc_id as id", "concat('ACC', doc_id) as accession", "text"), path, log))
    schema = read(spark, d, "documents").selectExpr("doc_id as id", "concat('ACC', doc_id) as accession", "text").schema
    known = imports.imported(spark, path, schema).select("accession")
    rows = genome(spark, d).join(known, "accession", "left_semi")
    return scan.keep_coding(scan.find_slipsites(rows, (100,)), do_utr=True).groupBy("accession").agg(F.count("*").alias("windows"))


@query("m2_running_index", "SELECT date_trunc('day', ts)::TIMESTAMP AS since, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def _(spark, d):
    path, log = work_dir(spark, "index"), work_dir(spark, "log")
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    _ended(imports.index_stream(imports.running_index(events, "event_type", "ts"), path, log))
    return imports.current_index(spark, path, "event_type").withColumn("since", F.col("since").cast("timestamp_ntz"))
