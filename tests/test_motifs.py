from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import motifs, nulls, signals, structure
from shiftlens.sources import readers


def stack_pairs(text):
    held, out = [], []
    for p, c in enumerate(text):
        if c == "(":
            held.append(p)
        elif c == ")" and held:
            out.append((held.pop(), p))
    return sorted(out)


def test_brackets_without_partners(spark):
    texts = ["", "....", ")))", "(((", ")(", "())(()", "(()))(()((", "..)(..(.)..)).(("]
    found = structure.parens_to_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, parens string")).collect()
    for k, text in enumerate(texts):
        assert sorted((r.i, r.j) for r in found if r.id == k) == stack_pairs(text), text


def test_stem_order_and_marks(spark):
    df = spark.createDataFrame([("((.[[..)).]]", list("33.11..33.11")), ("..", list(".."))], "parens string, parsed array<string>")
    row = df.select(structure.reorder_stems(F.col("parsed")).alias("o")).collect()
    assert ["".join(r.o) for r in row] == ["11.22..11.22", ".."]
    marks = df.withColumn("parsed", structure.reorder_stems(F.col("parsed"))).select(structure.stem_brackets(F.col("parens"), F.col("parsed")).alias("m"))
    assert [r.m for r in marks.collect()] == ["((.{{..)).}}", ".."]


def test_track(spark):
    genome = spark.createDataFrame([(1, "a", "ATGAAATTTACCCTAGGGTAA", 1, 21), (2, "b", "", 1, 0)], "id long, accession string, mrna_seq string, orf_start int, orf_stop int")
    sites = spark.createDataFrame([(1, 4, 3)], "id long, start int, bp_mstop int")
    snps = spark.createDataFrame([("a", 12), ("a", 900), ("zz", 1)], "accession string, position int")
    got = {r.id: r.track for r in motifs.annotate_bases(genome, sites, snps).collect()}
    assert got == {1: "GGGBBBBBBB.SOOO...RRR", 2: ""}


def test_knot_found(spark):
    # Stem 1 GGCGC with GCGCC, stem 2 AAGAG with CTCTT inside and behind it.
    text = "AAAAA" + "GGCGC" + "A" + "AAGAG" + "GCGCC" + "AAA" + "CTCTT" + "AAAA"
    found = motifs.motif_candidates(spark.createDataFrame([(1, text)], "id int, sequence string"))
    assert (5, 20, 5, 11, 28, 5) in [(r.i1, r.j1, r.n1, r.i2, r.j2, r.n2) for r in found.collect()]
    assert motifs.motif_candidates(spark.createDataFrame([(1, ""), (2, None), (3, "AAAA")], "id int, sequence string")).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(["MIM:1", "HGNC:7", "MIM:22", None],)], "x array<string>")
    assert df.select(S.xref_ids(F.col("x"), "MIM").alias("a"), S.xref_ids(F.col("x"), "GeneID").alias("b")).first() == ("1 22", None)
    codons = spark.range(1).select(S.alternates(F.lit("L"), F.lit("C.G")).alias("a"), S.alternates(F.lit("?"), F.lit("...")).alias("b"), S.alternates(F.lit("M"), F.lit("A.C")).alias("c")).first()
    assert codons == (["CTG"], [], [])
    spaces = spark.createDataFrame([("  . 1   2",), ("a   b",), ("",), (None,)], "s string").select(S.normalise_spaces(F.col("s")).alias("s"))
    assert [r.s for r in spaces.collect()] == [". 1 2", "a   b", "", None]


def test_same_slots_keep_protein(spark):
    text = "TTATCAAGCNNNTAACTGCGTA"
    rows = spark.createDataFrame([(k, text) for k in range(40)], "k int, s string")
    out = rows.select(nulls.same_slot_protein(F.col("s"), F.col("k")).alias("o"), S.translate(F.col("s")).alias("p")).withColumn("q", S.translate(F.col("o"))).collect()
    assert all(r.p == r.q and r.o[2::3] == text[:21][2::3] and r.o[3::3] == text[:21][3::3] for r in out)
    assert len({r.o for r in out}) > 1


def test_ranges_of_reads(spark):
    hits = spark.createDataFrame([(0,), (0,), (84,), (85,), (380,), (-20,), (None,)], "at int")
    got = {(r.lo, r.hi): (r.total, r.zero, r.plus, r.minus) for r in signals.binned_frame_counts(hits, signals.PROFILE_RANGES).collect()}
    assert got == {(0, 99): (3, 3, 0, 0), (100, 199): (1, 0, 0, 1), (300, 399): (1, 0, 1, 0), (390, 410): (1, 0, 1, 0)}


def test_mirna(spark):
    columns = "name string, accession string, species string, sequence string"
    hairpin = spark.createDataFrame([("hsa-mir-7-2", "MI2", "homo_sapiens", "acg"), ("hsa-mir-7-1", "MI1", "homo_sapiens", "acu")], columns)
    mature = spark.createDataFrame([("hsa-miR-7*", "M1", "homo_sapiens", "ac"), ("hsa-mir-8-5p", "M2", "homo_sapiens", "gg")], columns)
    merged = motifs.merge_mirna(hairpin, mature)
    got = {r.micro_name: (r.hairpin_accession, r.hairpin, r.star, r.fivep, r.mature) for r in merged.collect()}
    assert got == {"hsa-mir-7": ("MI1", "acu", "ac", None, None), "hsa-mir-8": (None, None, None, "gg", None)}
    assert sorted(r.value for r in motifs.mirna_fasta(merged).collect()) == [">hsa-mir-7-star MI1 M1\nac", ">hsa-mir-8-5p undefined M2\ngg"]


def test_species_folders_and_cloud(spark, tmp_path):
    table = spark.createDataFrame([(1, "Homo sapiens", -3.0), (2, "West Nile virus", -4.0), (3, "Zika virus", -5.0)], "id int, species string, mfe double")
    readers.write_by_species(table, str(tmp_path / "t"))
    one = readers.scan_species(spark, str(tmp_path / "t"), "Zika virus")
    assert sorted(r.id for r in one.collect()) == [2, 3]
    assert "species_key" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    assert readers.scan_species(spark, str(tmp_path / "t")).count() == 3
    readers.write_cloud(table, str(tmp_path / "c"), spark.createDataFrame([("x", "[1]")], "species string, series string"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c/points")).count() == 3
    assert spark.read.text(str(tmp_path / "c/series")).first().value == "[1]"


def test_half_lives(spark, tmp_path):
    path = tmp_path / "cohort.txt"
    path.write_text("YAL1\t12.5\t0.9\nYAL2\tx\t0.8\nYAL3\t7\t0.7\n")
    assert [tuple(r) for r in readers.read_half_lives(spark, str(path), 3).collect()] == [("YAL1", 12.5, 0.9), ("YAL2", None, 0.8)]
