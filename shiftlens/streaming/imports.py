"""Continuous import: sequences arrive as files, known accessions are ignored, sites are scanned, counts kept up to date.

Batches are written under their number, and a batch that runs again overwrites its own folder: nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from shiftlens.operators.scan import find_slipsites

#: Parts that the imported accessions are dealt over, so that a batch reads only the parts its accessions fall into.
PARTS = 64


def new_sites(genome_stream: DataFrame, seqlengths=(100, 75, 50), time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Windows of accessions seen for the first time. With a time column, an accession is remembered for `delay` only (the import
    below catches those that come back later); without, for ever."""
    if time is None:
        return find_slipsites(genome_stream.dropDuplicates(["accession"]), seqlengths)
    return find_slipsites(genome_stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["accession"]), seqlengths)


def import_batch(batch: DataFrame, number: int, path: str, by: str = "id") -> None:
    """Write the rows of a batch whose accession no other batch has (the least `by` of each) to path/batch=number/part=.. . Of the
    earlier batches only accessions are read, and only of the parts that this batch has."""
    spark = batch.sparkSession
    part = F.pmod(F.xxhash64("accession"), F.lit(PARTS)).cast("int")
    rows = batch.where(F.col("accession").isNotNull()).groupBy("accession").agg(F.min(F.struct(by, *[c for c in batch.columns if c not in (by, "accession")])).alias("r"))
    rows = rows.select("accession", "r.*").select(*batch.columns, part.alias("part"))
    parts = [r.part for r in rows.select("part").distinct().collect()]  # at most PARTS numbers
    known = [f"{path}/batch={k}" for k in range(number)]
    for folder in known:
        earlier = spark.read.schema("accession string, part int").parquet(folder).where(F.col("part").isin(parts))
        rows = rows.join(earlier.select("accession"), "accession", "left_anti")
    rows.select(*batch.columns, "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")


def import_stream(genome_stream: DataFrame, path: str, checkpoint: str, by: str = "id") -> DataStreamWriter:
    """A writer that imports each batch; read the table with imported()."""
    keep = lambda batch, number: import_batch(batch, number, path, by)
    return genome_stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def imported(spark, path: str, schema) -> DataFrame:
    """All rows imported so far."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{names}, batch int, part int").parquet(path).drop("batch", "part")


def running_index(stream: DataFrame, key: str, time: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Rows of each key by window of time. A window's count leaves the state `delay` after its end; rows later than that are lost."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("since"), key, "n")


def index_stream(counts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the counts that changed in each batch, under the batch's number."""
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)


def current_index(spark, path: str, key: str) -> DataFrame:
    """The last count of each window and key."""
    rows = spark.read.parquet(path)
    return rows.groupBy("since", key).agg(F.max_by("n", "batch").alias("n"))
