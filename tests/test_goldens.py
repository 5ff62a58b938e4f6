from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import scan, stats, structure


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


def test_reverse_complement_twice(spark):
    assert one(spark, "ACGTTGCA", lambda c: S.reverse_complement(S.reverse_complement(c))) == "ACGTTGCA"


def test_translate(spark):
    assert one(spark, "ATGAAATAGNNN", S.translate) == "MK*?"
    assert one(spark, "AT", S.translate) == ""


def test_shuffle_keeps_bases(spark):
    assert sorted(one(spark, "AACCGGTTA", lambda c: S.shuffled(c, F.lit(1)))) == sorted("AACCGGTTA")


def test_slipsite_coordinates(spark):
    genome = spark.createDataFrame([(1, "a", "GG" + "AAATTTA" + "C" * 30, 1, 39)], "id long, accession string, mrna_seq string, orf_start int, orf_stop int")
    row = scan.find_slipsites(genome, (10,)).collect()
    assert [(r.start, r.slipsite, r.sequence) for r in row] == [(3, "AAATTTA", "C" * 10)]


def test_parens_round_trip(spark):
    text = "..(((.)))..((..))"
    edges = structure.parens_to_pairs(spark.createDataFrame([(1, text)], "id long, parens string")).collect()
    partner = [None] * len(text)
    for e in edges:
        partner[e.i], partner[e.j] = e.j, e.i
    back = spark.createDataFrame([(partner,)], "p array<int>").select(structure.pairs_to_parens(F.col("p"))).first()[0]
    assert back == text


def test_barcodes(spark):
    stem = spark.createDataFrame([(1, 0, 11), (1, 1, 10), (1, 2, 9)], "id long, i int, j int")
    knot = spark.createDataFrame([(2, 0, 12), (2, 1, 11), (2, 6, 20), (2, 7, 19)], "id long, i int, j int")
    got = {r.id: r.barcode for r in structure.barcode(structure.assign_stems(stem.union(knot))).collect()}
    assert got == {1: "11", 2: "1212"}
    assert [r.id for r in structure.knotted(stem.union(knot)).collect()] == [2]


def test_zscore(spark):
    boot = spark.createDataFrame([(-16.3, -13.9, 3.0), (-5.0, -4.0, 0.0), (-5.0, -4.0, None)], "mfe double, mfe_mean double, mfe_sd double")
    assert [r.zscore for r in stats.zscores(boot).collect()] == [-0.8, -1.0, -1.0]


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert stats.missing_columns(df, ["a", "b"]).first().missing == ["b"]
