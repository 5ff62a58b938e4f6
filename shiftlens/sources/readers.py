"""Readers and writers of sequence files. Records are split by Spark's text source, so files of any size stay splittable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions import seq as S

HEADERS = {
    "sgd": {"accession": r"^(\S+)", "genename": r"^\S+\s+([^,]*)", "comment": r"^[^,]*,(.*)$"},
    "celegans": {"accession": r"^([^|]+)", "genename": r"^[^|]*\|(.*)$", "comment": r"^(.*)$"},
    "mgc": {"accession": r"^[^|]*\|[^|]*\|[^|]*\|([^|.]+)", "genename": r"^[^|]*\|([^|]*)", "comment": r"^(?:[^|]*\|){4}\s*(.*)$"},
    "misc": {"accession": r"^(?:ORFN:?)?(\S+)", "genename": r"^(?:ORFN:?)?(\S+)", "comment": r"^\S+\s*(.*)$"},
}


def parse_fasta(records: DataFrame, style: str = "misc", column: str = "value") -> DataFrame:
    """One row a record: accession, genename, comment, mrna_seq; white space and digits leave the sequence, the ORF is all of it."""
    text = F.regexp_replace(F.col(column), "^>", "")
    header = F.regexp_extract(text, r"^([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"[\s0-9]", "")
    out = records.where(F.trim(text) != "").select(*[F.trim(F.regexp_extract(header, p, 1)).alias(name) for name, p in HEADERS[style].items()], seq.alias("mrna_seq"))
    return out.withColumn("orf_start", F.lit(1)).withColumn("orf_stop", F.length("mrna_seq"))


def read_fasta(spark: SparkSession, path: str, style: str = "misc") -> DataFrame:
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path), style)


def fasta_record(header: Column, seq: Column, width: int = 80) -> Column:
    """>header and the sequence in lines of `width`."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def write_fasta(records: DataFrame, path: str, header: Column, seq: Column) -> None:
    records.select(fasta_record(header, seq)).write.option("compression", "gzip").text(path)


def parse_location(location: Column) -> Column:
    """Struct of a feature's location (a..b, join(..), order(..), complement(..), nested): whole (whether all of it is read backwards)
    and parts, structs lo, hi and back in the order in which they are spliced. Partial ends (< and >) count as whole ones; a
    location in another record (with a colon) or none at all gives null."""
    text = F.regexp_replace(location, r"\s", "")
    pieces = F.regexp_extract_all(text, F.lit(r"((?:complement\()?[<>]?[0-9]+(?:\.\.[<>]?[0-9]+)?)"), F.lit(1))

    def part(piece: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(piece, F.lit(r"([0-9]+)"), F.lit(1)), lambda n: n.cast("int"))
        return F.struct(F.get(ends, F.lit(0)).alias("lo"), F.element_at(ends, -1).alias("hi"), piece.startswith("complement").alias("back"))

    whole = text.rlike(r"^complement\((join|order)\(")
    usable = (F.size(pieces) > 0) & ~text.contains(":")
    return F.when(usable, F.struct(whole.alias("whole"), F.transform(pieces, part).alias("parts")))


def spliced(seq: Column, location: Column) -> Column:
    """The bases of a parsed location (parse_location) of a sequence, exons joined, on their own strand."""

    def read(p: Column) -> Column:
        own = F.substring(seq, p["lo"], p["hi"] - p["lo"] + 1)
        return F.when(p["back"], S.reverse_complement(own)).otherwise(own)

    joined = F.array_join(F.transform(location["parts"], read), "")
    return F.when(location["whole"], S.reverse_complement(joined)).otherwise(joined)


def exon_frames(location: Column, first: Column) -> Column:
    """Structs lo, hi and frame of each exon as it is read: how many bases of a codon the exons before it (and `first` bases that are
    skipped at the start) leave open."""
    parts = F.when(location["whole"], F.reverse(location["parts"])).otherwise(location["parts"])
    size = lambda p: p["hi"] - p["lo"] + 1
    before = lambda own, i: F.aggregate(F.slice(own, 1, i), F.lit(0), lambda n, p: n + size(p))
    return S.let(parts, lambda own: F.transform(own, lambda p, i: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"), F.pmod(before(own, i) - first, F.lit(3)).alias("frame"))))


def parse_genbank(records: DataFrame, padding: int = 300, per_orf_accession: bool = False, column: str = "value") -> DataFrame:
    """A row for each CDS of each record: accession, gene, direction, mrna_seq, orf_start, orf_stop, exons.

    mrna_seq is the spliced coding part with `padding` bases of the record on both sides (fewer at its ends), read on its own strand;
    orf_start and orf_stop (1-based) are the coding part in it, from the base that /codon_start names. With per_orf_accession the
    accession ends in a dash and the first base of the location. A CDS that lies in another record too is left out."""
    text = F.col(column)
    seq = F.upper(F.regexp_replace(F.substring_index(text, "\nORIGIN", -1), r"[^A-Za-z]", ""))
    blocks = F.regexp_extract_all(text, F.lit(r"\n {5}CDS {2,}([^\n]*(?:\n {21}[^\n]*)*+)"), F.lit(1))
    rows = records.where(text.contains("LOCUS") & text.contains("\nORIGIN")).select(F.regexp_extract(text, r"\nACCESSION\s+(\S+)", 1).alias("accession"), seq.alias("__s"), F.explode(blocks).alias("__b"))
    quoted = lambda name: F.nullif(F.regexp_extract("__b", f'/{name}="([^"]*)"', 1), F.lit(""))
    skipped = F.coalesce(F.nullif(F.regexp_extract("__b", r"/codon_start=([1-3])", 1), F.lit("")).cast("int") - 1, F.lit(0))
    rows = rows.select("accession", "__s", quoted("gene").alias("gene"), skipped.alias("__skip"), parse_location(F.regexp_extract("__b", r"^([^/]*)", 1)).alias("__l")).where("__l is not null")
    parts = F.col("__l.parts")
    low, high = F.array_min(F.transform(parts, lambda p: p["lo"])), F.array_max(F.transform(parts, lambda p: p["hi"]))
    rows = rows.withColumn("__lo", low).withColumn("__hi", high).withColumn("__c", spliced(F.col("__s"), F.col("__l")))
    begin = F.greatest(F.col("__lo") - padding, F.lit(1))
    left, right = F.substring("__s", begin, F.col("__lo") - begin), F.substring("__s", F.col("__hi") + 1, F.lit(padding))
    back = F.col("__l.whole") | F.forall(parts, lambda p: p["back"])
    head = F.when(back, S.reverse_complement(right)).otherwise(left)
    tail = F.when(back, S.reverse_complement(left)).otherwise(right)
    own = F.concat(F.col("accession"), F.lit("-"), F.col("__lo")) if per_orf_accession else F.col("accession")
    return rows.select(
        own.alias("accession"), "gene", F.when(back, "reverse").when(F.exists(parts, lambda p: p["back"]), "mixed").otherwise("forward").alias("direction"),
        F.concat(head, F.col("__c"), tail).alias("mrna_seq"), (F.length(head) + 1 + F.col("__skip")).cast("int").alias("orf_start"),
        (F.length(head) + F.length("__c")).cast("int").alias("orf_stop"), exon_frames(F.col("__l"), F.col("__skip")).alias("exons"),
    )


def read_genbank_cds(spark: SparkSession, path: str, padding: int = 300, per_orf_accession: bool = False) -> DataFrame:
    """parse_genbank of a file or folder; records are split by Spark's text source, so one may lie over two splits."""
    return parse_genbank(spark.read.option("lineSep", "\n//").text(path), padding, per_orf_accession)


def read_ct(spark: SparkSession, path: str) -> DataFrame:
    """file, position, base, partner (1-based; 0: unpaired) and energy of connect tables. The first line of a file (length, name, perhaps
    `ENERGY = x`) gives the energy; it is joined by file, so files stay splittable."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("v"))
    part = F.split("v", r"\s+")
    rows = lines.where(r"v rlike '^[0-9]+\\s+[A-Za-z]\\s+[0-9]+\\s+[0-9]+\\s+[0-9]+\\s+[0-9]+$'")
    rows = rows.select("file", F.get(part, F.lit(0)).cast("int").alias("position"), F.get(part, F.lit(1)).alias("base"), F.get(part, F.lit(4)).cast("int").alias("partner"))
    heads = lines.where("v like '%ENERGY%'").groupBy("file").agg(F.min(F.regexp_extract("v", r"ENERGY\s*=\s*(-?[0-9.]+)", 1)).try_cast("double").alias("energy"))
    return rows.join(heads, "file", "left")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments without header lines; accession is the fourth part of the reference name, without its version."""
    part = F.split("value", "\t")
    names = ["read_id", "flag", "refname", "pos", "mapq", "cigar"]
    rows = spark.read.text(path).where("value <> '' and substring(value, 1, 1) <> '@'").select(*[F.get(part, F.lit(k)).cast("int" if n in ("flag", "pos", "mapq") else "string").alias(n) for k, n in enumerate(names)])
    return rows.withColumn("accession", F.regexp_replace(F.coalesce(F.get(F.split("refname", r"\|"), F.lit(3)), "refname"), r"\.[0-9]+$", ""))


def read_tag_table(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """Tag tables of eight columns; comments, mitochondrial and plasmid references are left out."""
    kinds = {"tag_seq": "string", "tag_count": "int", "score": "double", "refname": "string", "refstart": "int", "refend": "int", "len": "int", "ambig": "int"}
    part = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and substring(value, 1, 1) <> '#'").select(*[F.get(part, F.lit(k)).cast(kind).alias(n) for k, (n, kind) in enumerate(kinds.items())])
    return rows.where(~F.col("refname").rlike("Mito|micron")).withColumn("experiment", F.lit(experiment))


def read_pars(spark: SparkSession, path: str) -> DataFrame:
    """orf, position (0-based), value of lines `orf length v;v;v`."""
    part = F.split("value", r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(F.get(part, F.lit(0)).alias("orf"), F.posexplode(F.split(F.get(part, F.lit(2)), ";")).alias("position", "v")).where("v <> ''").select("orf", "position", F.col("v").cast("double").alias("value"))


def read_paired_expression(spark: SparkSession, path: str) -> DataFrame:
    """gene, pair, healthy, cancer of comma-separated lines `gene, (healthy, cancer)*`."""
    part = F.split("value", r"\s*,\s*")
    pairs = F.transform(F.sequence(F.lit(1), F.size(part) - 2, F.lit(2)), lambda i: F.struct(F.get(part, i).cast("double").alias("healthy"), F.get(part, i + 1).cast("double").alias("cancer")))
    return spark.read.text(path).where(F.size(part) >= 3).select(F.get(part, F.lit(0)).alias("gene"), F.posexplode(pairs).alias("pair", "p")).select("gene", "pair", "p.healthy", "p.cancer")


def read_known_signals(spark: SparkSession, path: str, mode: str = "all") -> DataFrame:
    """accession, position from a table of comma lists; all combinations by place, or the first of each row."""
    rows = spark.read.csv(path, sep="\t").select(F.split("_c0", r"\s*,\s*").alias("a"), F.split("_c1", r"\s*,\s*").alias("p"))
    rows = rows.select(F.posexplode(F.arrays_zip("a", "p")).alias("k", "x")).where("k = 0" if mode == "first" else "true")
    return rows.select(F.col("x.a").alias("accession"), F.col("x.p").cast("int").alias("position")).where("position is not null")


def read_bpseq(spark: SparkSession, path: str) -> DataFrame:
    """file, position, base, partner (1-based; 0: unpaired)."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(r"trim(value) rlike '^[0-9]+\\s+[A-Za-z]\\s+[0-9]+$'")
    return rows.select(F.input_file_name().alias("file"), F.get(part, F.lit(0)).cast("int").alias("position"), F.get(part, F.lit(1)).alias("base"), F.get(part, F.lit(2)).cast("int").alias("partner"))


def read_half_lives(spark: SparkSession, path: str, n: int) -> DataFrame:
    """gene, half_life, r2 of the first n - 1 lines of one tab-separated file; lines are numbered by their place in the file."""
    part = F.split("line", "\t")
    # The cohort file is one small table: its lines stay together, so that they keep their numbers.
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("k", "line"))
    return lines.where(F.col("k") < n - 1).select(F.get(part, F.lit(0)).alias("gene"), F.get(part, F.lit(1)).try_cast("double").alias("half_life"), F.get(part, F.lit(2)).try_cast("double").alias("r2"))


def write_by_species(df: DataFrame, path: str) -> None:
    """Parquet with a folder for each species key; a species is dealt over the tasks that hold its rows, so a large one isn't one task."""
    df.withColumn("species_key", S.species_key(F.col("species"))).write.mode("overwrite").partitionBy("species_key").parquet(path)


def scan_species(spark: SparkSession, path: str, species: str | None = None) -> DataFrame:
    """A table written by species: all of it, or the folder of one species (viruses share one), so that no other is read."""
    table = spark.read.parquet(path)
    return table if species is None else table.where(F.col("species_key") == S.species_key(F.lit(species)))


def write_cloud(points: DataFrame, path: str, series: DataFrame | None = None) -> None:
    """Cloud points as CSV with a header under path/points, and JSON series (key, series) as text under path/series."""
    columns = ("mfe", "zscore", "accession", "start", "knotp", "slipsite", "id")
    points.select(*[c for c in columns if c in points.columns]).write.mode("overwrite").option("header", True).csv(f"{path}/points")
    if series is not None:
        series.select("series").write.mode("overwrite").text(f"{path}/series")
