"""Record locations, connect tables, labels, compositions, cells, lookups, related rows and statistics on small and hostile input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import points, scan, signals, stats, structure
from shiftlens.sources import readers

BACK = str.maketrans("ACGT", "TGCA")


def cut(seq, location):
    """A location of a sequence by the rules of its grammar."""
    if location.startswith("complement("):
        return cut(seq, location[11:-1])[::-1].translate(BACK)
    if location.startswith(("join(", "order(")):
        depth, part, out = 0, "", []
        for c in location[location.index("(") + 1 : -1] + ",":
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(cut(seq, part))
                part = ""
            else:
                part += c
        return "".join(out)
    ends = [int(x.strip("<>")) for x in location.split("..")]
    return seq[ends[0] - 1 : ends[-1]]


LOCATIONS = [
    "5..20", "<5..>20", "complement(5..20)", "join(3..9,20..31)", "complement(join(3..9,20..31,40..41))", "join(complement(20..31),complement(3..9))",
    "join(3..9,complement(20..31))", "order(3..5,7)", "7",
]


def record(name, seq, location, extra=""):
    broken = location.replace(",", ",\n" + " " * 21)
    lines = "\n".join(f"{k * 20 + 1:>9} " + " ".join(seq[k * 20 :][:20][j : j + 10] for j in (0, 10)).lower() for k in range(-(-len(seq) // 20)))
    return f"LOCUS       {name}\nACCESSION   {name}\nFEATURES             Location/Qualifiers\n     gene            1..9\n     CDS             {broken}\n{' ' * 21}/gene=\"g{name}\"\n{extra}     misc            2..3\nORIGIN\n{lines}\n"


def test_locations_by_their_grammar(spark, tmp_path):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in LOCATIONS]
    text = "//\n".join(record(f"R{k}", s, loc) for k, (s, loc) in enumerate(zip(seqs, LOCATIONS))) + "//\n" + record("FAR", seqs[0], "join(J1.1:3..9,4..5)") + "//\nLOCUS       no\n//\n"
    (tmp_path / "a.gb").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")  # records lie over the borders of splits
    try:
        frame = readers.read_genbank_cds(spark, str(tmp_path), 4, True)
        assert frame.rdd.getNumPartitions() > 3
        got = {r.accession.split("-")[0]: r for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == [f"R{k}" for k in range(len(LOCATIONS))]
    for k, (seq, location) in enumerate(zip(seqs, LOCATIONS)):
        r = got[f"R{k}"]
        coding = cut(seq, location)
        assert r.mrna_seq[r.orf_start - 1 : r.orf_stop] == coding and r.gene == f"gR{k}"
        low, high = (f(int(x) for x in __import__("re").findall("[0-9]+", location)) for f in (min, max))
        sides = (seq[max(0, low - 5) : low - 1], seq[high : high + 4])
        if r.direction == "reverse":
            sides = tuple(s[::-1].translate(BACK) for s in sides[::-1])
        assert r.mrna_seq == sides[0] + coding + sides[1] and r.accession.endswith(f"-{low}")
    assert [got[f"R{k}"].direction for k in range(9)] == ["forward", "forward", "reverse", "forward", "reverse", "reverse", "mixed", "forward", "forward"]
    assert [e.frame for e in got["R3"].exons] == [0, 1] and [(e.lo, e.frame) for e in got["R4"].exons] == [(40, 0), (20, 2), (3, 2)]


def test_codon_start(spark):
    rows = spark.createDataFrame([(record("A", "ACGT" * 15, "5..20", " " * 21 + "/codon_start=2\n"),), (None,), ("",)], "value string")
    r = readers.parse_genbank(rows, 2).collect()
    assert len(r) == 1 and (r[0].orf_start, r[0].orf_stop, r[0].exons[0].frame) == (4, 18, 2)


def test_connect_tables(spark, tmp_path):
    s = spark.createDataFrame([(1, "GGAAACC", "((...))"), (2, "A", "."), (3, "", "")], "id int, sequence string, parens string")
    rows = sorted(tuple(r) for r in signals.to_ct(s, structure.parens_to_pairs(s), "AT").where("id = 1").collect())
    assert rows[0] == (1, 1, "A", 0, 2, 0) and rows[2] == (1, 3, "G", 2, 4, 9) and rows[8] == (1, 9, "C", 8, 0, 3)
    assert signals.to_ct(s, structure.parens_to_pairs(s)).where("id = 2").first().after == 0
    (tmp_path / "x.ct").write_text("7 ENERGY = -3.5 name\n" + "".join(f"{k} {b} {k - 1} {k + 1} {p} {k}\n" for k, b, p in ((1, "G", 7), (2, "A", 0), (7, "C", 1))))
    (tmp_path / "y.ct").write_text("1 none\n1 A 0 0 0 1\n")
    got = sorted((r.position, r.base, r.partner, r.energy) for r in readers.read_ct(spark, str(tmp_path)).collect())
    assert sorted(got, key=str) == sorted([(1, "G", 7, -3.5), (2, "A", 0, -3.5), (7, "C", 1, -3.5), (1, "A", 0, None)], key=str)


def test_labels(spark):
    df = spark.createDataFrame([("homo_sapiens", "SGDID:Y.2", "chr04", "uuuaaag", "ACGTACGTA"), (None, None, None, None, None), ("x", "a.b.3", "17", "AAAAAAA", "ACG")], "k string, a string, c string, h string, s string")
    row = df.select(
        S.species_label(F.col("k")), S.clean_accession(F.col("a")), S.clean_accession(F.col("a"), "underscore"), S.chromosome_label(F.col("c")),
        S.is_slippery(F.col("h")), S.is_slippery(F.col("h"), True), S.heptamer_at(F.col("s"), F.lit(2)),
    ).collect()
    assert tuple(row[0]) == ("Homo sapiens", "Y", "Y_2", "IV", True, False, "CGTACGT")
    assert tuple(row[1]) == (None,) * 7 and tuple(row[2]) == ("X", "a.b", "a_b_3", "17", True, True, None)


def test_gc_of_stems(spark):
    df = spark.createDataFrame([("GGAAACA", list("11...11")), ("AAA", list("...")), (None, None), ("", [])], "s string, p array<string>")
    assert [r[0] for r in df.select(S.gc_stems(F.col("s"), F.col("p"))).collect()] == [75.0, None, None, None]


def test_composition_and_stops(spark):
    g = spark.createDataFrame([(1, "ACGTAAC", 1, 7), (2, "", 1, 0), (3, None, 1, 0)], "id int, mrna_seq string, orf_start int, orf_stop int")
    got = {(r.kind, r.slots, r.key): r.n for r in scan.composition_by_sequence(g).collect()}
    assert got[("pair", "3-1", "GT")] == 1 and got[("pair", "1-3", "AG")] == 1 and got[("codon", "", "TAA")] == 1 and ("base", "1", "C") not in got
    g = spark.createDataFrame([(1, "TAATAG" + "TAACCCTGA" + "TTAGTGA", 7, 15)], "id int, mrna_seq string, orf_start int, orf_stop int")
    got = {(r.region, r.frame, r.distance): r.n for r in scan.stop_distances_by_region(g).collect()}
    assert got == {("5utr", 0, 1): 1, ("orf", 0, 2): 1, ("3utr", 1, 1): 1}


def test_columns_of_an_alignment(spark):
    df = spark.createDataFrame([("a", "AC"), ("b", "AG"), ("c", "TC"), ("d", None), ("e", "")], "id string, sequence string")
    one = {(r["column"], r.base): (r.n, r.share) for r in signals.column_composition(df).collect()}
    assert one == {(0, "A"): (2, 0.6667), (0, "T"): (1, 0.3333), (1, "C"): (2, 0.6667), (1, "G"): (1, 0.3333)}
    two = {(r.b1, r.b2): (r.n, r.joint, r.ratio) for r in signals.column_pairs(df).collect()}
    assert two == {("A", "C"): (1, 0.3333, 0.75), ("A", "G"): (1, 0.3333, 1.5), ("T", "C"): (1, 0.3333, 1.5)}


def test_histogram_beside_the_normal(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("k", rng.gauss(0, 1)) for _ in range(500)] + [("flat", 2.0)] * 3 + [("k", None)], "key string, v double")
    rows = signals.histogram_with_normal(df, "key", "v").collect()
    assert {r.key for r in rows} == {"k"} and sum(r.n for r in rows) == 500 and abs(sum(r.expected for r in rows) - 1) < 0.02
    assert max(abs(r.share - r.expected) for r in rows) < 0.06


def test_cells_and_members(spark):
    df = spark.createDataFrame([(-10.04, -1.001, True, "a"), (-10.03, -1.002, False, "a"), (-20.0, 2.0, False, "b")], "mfe double, zscore double, knotp boolean, accession string")
    got = {(r.mfe10, r.z100): (r.n, r.knotted, r.genes, r.share, r.quadrant) for r in points.cloud_cells(df).collect()}
    assert got == {(-100, -100): (2, 1, 1, 1.0, "high/low"), (-200, 200): (1, 0, 1, 0.5, "low/high")}
    assert points.cloud_members(df).count() == 2 and points.cloud_cells(df.limit(0)).count() == 0


def test_lookup_keeps_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, name string")
    table = spark.createDataFrame([(1, "b", 5), (1, "a", 9), (3, "c", 1), (None, "q", 1)], "key int, label string, name int")
    for small in (100, 0):  # broadcast or not
        got = Counter((r.k, r.label, r.name) for r in points.lookup(df, table, {"k": "key"}, {"label": "label", "name": "name"}, small).collect())
        assert got == Counter({(1, "a", 9): 2, (2, None, None): 1, (None, None, None): 1})


def test_related_rows_and_duplicates(spark):
    genes = spark.createDataFrame([("a", "A"), ("b", "B")], "accession string, genename string")
    mfe = spark.createDataFrame([("a", 5, "AAAAAAA"), ("a", 5, "AAAAAAA"), ("z", 1, "C")], "accession string, start int, slipsite string")
    snps, xrefs = spark.createDataFrame([("a", 7)], "accession string, position int"), spark.createDataFrame([("a", "HGNC:1")], "accession string, xref string")
    got = {tuple(r) for r in points.related_rows(genes, mfe, snps, xrefs).collect()}
    assert got == {("a", "A", "site", "5 AAAAAAA", 2), ("a", "A", "variant", "7", 1), ("a", "A", "xref", "HGNC:1", 1), ("b", "B", "none", None, 0)}
    m = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", 4)], "id int, accession string, pairs int")
    kept, boot = points.without_duplicates(m, spark.createDataFrame([(1, 1), (2, 2)], "mfe_id int, x int"), ["accession", "pairs"])
    assert sorted(r.id for r in kept.collect()) == [1, 3] and [r.mfe_id for r in boot.collect()] == [1]


def test_small_statistics(spark):
    m = spark.createDataFrame([(1,), (2,)], "id int")
    boot = spark.createDataFrame([(1, "r", "m"), (1, "r", "m"), (9, "r", "m")], "mfe_id int, rand_method string, mfe_method string")
    got = {tuple(r) for r in points.missing_randomizations(m, boot, ["r", "s"], ["m"]).collect()}
    assert got == {(1, "s", "m"), (2, "r", "m"), (2, "s", "m")}
    pairs = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 3.0), ("g", None, 1.0), ("h", 1.0, 2.0)], "gene string, healthy double, cancer double")
    got = {r.gene: r for r in points.expression_stats(pairs).collect()}
    assert (got["g"].n, got["g"].correlation, got["h"].correlation) == (2, 1.0, None) and got["h"].mean == pytest.approx(2.7183)
    assert stats.text_search(spark.createDataFrame([("s", "a b"), ("t", "a b"), ("s", None)], "species string, comment string"), "+a", species="s").count() == 1
    ext = spark.createDataFrame([("M" * 31, 151), ("M" * 30, 151), (None, 999), ("M" * 40, None)], "minus_orf string, bp_mstop int")
    assert points.long_extensions(ext).count() == 1


def test_score_bands_by_rank(spark):
    rng = random.Random(8)
    rows = [("s", float(rng.choice([1, 2, 2, 5, 9, 1e6]) * rng.random())) for _ in range(300)] + [("t", 1.0)] * 4 + [("t", None)]
    got = stats.score_bands(spark.createDataFrame(rows, "species string, score double"), "score", 10, 16).collect()
    own = sorted(x for s, x in rows if s == "s")
    assert len(got) == 304 and all(r.band == (own.index(r.score) * 10 // 300 if r.species == "s" else 0) for r in got)


def test_distributions(spark):
    df = spark.createDataFrame([(1.0, True, "a"), (1.9, False, None), (4.2, True, "a"), (None, True, "b")], "x double, knotp boolean, s string")
    got = {r.bin: (r.unknotted, r.knotted) for r in stats.distribution(df, "x", 1).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (0, 1)}
    got = {(r.bin, r.series): r.n for r in points.axis_distribution(df, "x", 1.0, 0.0, F.col("s")).collect()}
    assert got == {(k, s): {(0, "a"): 1, (0, None): 1, (3, "a"): 1}.get((k, s), 0) for k in range(4) for s in ("a", None)}
    assert stats.distribution(df.limit(0), "x", 1).count() == 0 and points.axis_distribution(df.limit(0), "x", 1.0, 0.0, F.col("s")).count() == 0
    wide = spark.createDataFrame([(0.0, True), (3e6, False)], "x double, knotp boolean")
    assert stats.distribution(wide, "x", 1).count() == 3_000_001
