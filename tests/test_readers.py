from pyspark.sql import functions as F

from shiftlens.operators import nulls, signals
from shiftlens.sources import readers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "a.fa", ">YAL1 gene1,some words\nacgt\n10 ACG\n>YAL2 gene2,more\nTTT\n")
    rows = [tuple(r) for r in readers.read_fasta(spark, path, "sgd").orderBy("accession").collect()]
    assert rows == [("YAL1", "gene1", "some words", "acgtACG", 1, 7), ("YAL2", "gene2", "more", "TTT", 1, 3)]


def test_genbank(spark, tmp_path):
    text = "LOCUS x\nACCESSION   AB1\nFEATURES\n     CDS             3..8\n     CDS             complement(2..7)\nORIGIN\n        1 ttatgaaatc\n//\n"
    rows = readers.read_genbank_cds(spark, write(tmp_path / "a.gb", text), padding=1).orderBy("direction").collect()
    assert [(r.direction, r.mrna_seq, r.orf_start, r.orf_stop) for r in rows] == [("forward", "TATGAAAT", 2, 7), ("reverse", "TTTCATAA", 2, 7)]


def test_tables(spark, tmp_path):
    sam = readers.read_sam(spark, write(tmp_path / "a.sam", "@HD\nr1\t0\tgi|1|ref|NM_1.2|\t7\t255\t28M\n")).first()
    assert (sam.accession, sam.pos) == ("NM_1", 7)
    assert [tuple(r) for r in readers.read_pars(spark, write(tmp_path / "p", "o1\t3\t1;;2.5\n")).collect()] == [("o1", 0, 1.0), ("o1", 2, 2.5)]
    assert [tuple(r) for r in readers.read_paired_expression(spark, write(tmp_path / "e", "g,1,2,3,4\nh\n")).collect()] == [("g", 0, 1.0, 2.0), ("g", 1, 3.0, 4.0)]
    tags = readers.read_tag_table(spark, write(tmp_path / "t", "#c\nA\t1\t0.5\tchr1\t5\t9\t4\t0\nA\t1\t0.5\tMito\t5\t9\t4\t0\n"), "x").collect()
    assert [(r.refname, r.refstart, r.experiment) for r in tags] == [("chr1", 5, "x")]
    known = write(tmp_path / "k", "A1,A2\t5,6\n")
    assert [tuple(r) for r in readers.read_known_signals(spark, known).collect()] == [("A1", 5), ("A2", 6)]
    assert readers.read_known_signals(spark, known, "first").count() == 1
    assert [(r.position, r.partner) for r in readers.read_bpseq(spark, write(tmp_path / "b", "# x\n1 g 2\n2 c 1\n")).collect()] == [(1, 2), (2, 1)]


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT" * 50), ("b", "A")], "acc string, s string")
    readers.write_fasta(df, str(tmp_path / "out"), F.col("acc"), F.col("s"))
    back = {r.accession: r.mrna_seq for r in readers.read_fasta(spark, str(tmp_path / "out" / "*.gz")).collect()}
    assert back == {"a": "ACGT" * 50, "b": "A"}


def test_doublets_come_from_the_sequence(spark):
    out = spark.createDataFrame([("AACCGG",)], "s string").select(nulls.drawn_doublets(F.col("s"), F.lit(1)).alias("x")).first().x
    assert len(out) == 6 and {out[i : i + 2] for i in (0, 2, 4)} <= {"AA", "CC", "GG"}


def test_series(spark):
    df = spark.createDataFrame([("g", "m", 2, 1.5), ("g", "m", 1, 0.5)], "k string, l string, x int, y double")
    assert signals.series_json(df, "k", "l", "x", "y").first().series == '[{"label":"m","data":[[1.0,0.5],[2.0,1.5]]}]'
