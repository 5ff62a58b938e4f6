"""Work done in a window's row against the same work on rows of bases."""

import hashlib
import random

from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import motifs, nulls, seeds, signals, similar, stats, structure
from shiftlens.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brackets(rng, n):
    return "".join(rng.choice("((.))é" if rng.random() < 0.1 else "(.)") for _ in range(n))


def test_window_agreement_against_rows_of_bases(spark):
    rng = random.Random(4)
    rows = [(k, *(brackets(rng, k % 30) for _ in range(3))) for k in range(200)] + [(900, "(((", "..)", ")))"), (901, None, "()", "()"), (902, "", "", "")]
    df = spark.createDataFrame(rows, "id int, n string, h string, p string").repartition(3)
    said = None
    for m in "nhp":
        s = df.where(f"{m} <> ''").select("id", F.col(m).alias("parens"))
        one = signals.to_bpseq(s, structure.parens_to_pairs(s)).withColumn("mfe_method", F.lit(m))
        said = one if said is None else said.unionByName(one)
    for compat in (False, True):
        want = sorted(map(tuple, structure.base_agreement(said, ["id"], ("n", "h", "p"), compat).collect()))
        assert sorted(map(tuple, structure.window_agreement(df, ["id"], ("n", "h", "p"), compat).collect())) == want
    uneven = spark.createDataFrame([(1, "()..", "().", "()")], "id int, n string, h string, p string")
    assert structure.window_agreement(uneven, ["id"], ("n", "h", "p")).first().all_agree == 2
    assert structure.window_agreement(df.limit(0), ["id"], ("n", "h", "p")).count() == 0


def test_agreement_histogram_shuffles_counts_only(spark):
    """One exchange, of the counted values; rows of bases are never dealt."""
    assert plan(registry.QUERIES["t10_agreement_histogram"](spark, SF)).count("Exchange hashpartitioning") == 1


def test_nine_counters_are_not_shuffled(spark):
    assert "Exchange" not in plan(registry.QUERIES["t9_nine_counters"](spark, SF))


def test_connect_table_against_edges(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("ACGT") for _ in range(k % 25)), brackets(rng, k % 25)) for k in range(60)] + [(90, "ACG", None), (91, None, "()"), (92, "AC", "(()))"), (93, "ACGTA", "()")]
    s = spark.createDataFrame(rows, "id int, sequence string, parens string")
    for prefix in ("", "AAATTTA"):
        want = signals.to_ct(s, structure.parens_to_pairs(s), prefix)
        got = signals.connect_table(structure.with_partners(s), prefix)
        assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "Exchange" not in plan(registry.QUERIES["k5_connect_tables"](spark, SF))


def test_seed_words_and_members(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(40))) for _ in range(80)] + ["", None, "éACGTACGé", "ACGTAC"]
    windows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, w string").repartition(3)
    words = sorted({t[p : p + 7] for t in texts if t for p in range(0, len(t) - 6, 3)} | {"CGTACGé"})[::2] + ["ACG", None]
    wanted = spark.createDataFrame([(w,) for w in words * 2], "word string")
    want = sorted((k, p, t[p : p + 7]) for k, t in enumerate(texts) if t for p in range(len(t) - 6) if t[p : p + 7] in words)
    read = lambda: sorted((r.id, r.at, r.word) for r in seeds.word_places(windows, wanted).collect())
    assert read() == want and len(want) > 100
    members = spark.createDataFrame([(w, k) for k, w in enumerate(words * 5)] + [(words[0], None)], "word string, mirna int")
    pairs = sorted(str((*x, k)) for x in want for k in [*(k for k, w in enumerate(words * 5) if w == x[2]), *([None] if x[2] == words[0] else [])])
    for many in (1_000_000, 3):
        met = seeds.for_each_member(seeds.word_places(windows, wanted), members, "word", "mirna", "id", many)
        assert sorted(str((r.id, r.at, r.word, r.mirna)) for r in met.collect()) == pairs
    monkeypatch.setattr(seeds, "SMALL", 3)
    assert read() == want


def test_reported_targets_count_hits_by_sequence(spark):
    """Equal microRNAs are extended once: the plan joins hits by sequence, and counts are those of all scored hits."""
    rng = random.Random(7)
    sequences = ["".join(rng.choice("GC") for _ in range(9)) for _ in range(6)]
    rna = spark.createDataFrame([(k, sequences[k % 6]) for k in range(50)] + [(90, None), (91, "ACG")], "mirna int, sequence string")
    back = str.maketrans("ACGT", "TGCA")
    windows = spark.createDataFrame([(k, "ACCA" + sequences[k % 6][::-1].translate(back) * 2 + "TTG") for k in range(20)], "id int, sequence string")
    hits = [r for r in similar.scored_targets(rna, windows, None).collect() if r.energy <= -25]
    want = {m: (sum(r.mirna == m for r in hits), min(r.energy for r in hits if r.mirna == m)) for m in {r.mirna for r in hits}}
    got = {r.mirna: (r.hits, r.best) for r in similar.reported_targets(rna, windows, -25).collect()}
    assert got == want and len(want) == 50


def test_scored_targets_stay_where_they_are(spark):
    """Neither windows nor hits are dealt by word: no sorted join, and nothing but the lists of microRNAs is shuffled."""
    text = plan(registry.QUERIES["j14_scored_targets"](spark, SF))
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") <= 2 and "collect_list" in text


def test_mirna_places_are_not_dealt_by_word(spark):
    text = plan(registry.QUERIES["j14_mirna_targets"](spark, SF))
    assert "SortMergeJoin" not in text and "collect_list" in text


def test_contained_counts_against_all_pairs(spark):
    """Reads are never joined with the genes that hold them."""
    rng = random.Random(8)
    spots = [(rng.choice((0, 1, 2, None)), rng.choice((None, *range(-40, 60)))) for _ in range(400)]
    spans = [(k % 70, rng.choice((0, 1, 3, None)), lo, lo + rng.randrange(-3, 40)) for k, lo in enumerate(rng.randrange(-50, 50) for _ in range(90))] + [(80, 1, None, 9), (81, 1, 3, None)]
    want = {}
    for value, key, lo, hi in spans:
        n = sum(key is not None and key == c and None not in (at, lo, hi) and lo < at and at + 5 < hi for c, at in spots)
        want[value] = want.get(value, 0) + n
    a, b = spark.createDataFrame(spots, "key int, at long"), spark.createDataFrame(spans, "value int, key int, lo long, hi long")
    for scale in (7, 4096):
        got = {r.value: r.n for r in stats.contained_counts(a, b, "key", "value", 5, scale).collect()}
        assert got == {k: n for k, n in want.items() if n} and len(got) > 20
    assert "Generate explode(array" in (text := plan(registry.QUERIES["j8_reads_in_genes"](spark, SF))) and "sequence(" not in text


def test_landscape_windows_are_folded_before_they_are_dealt(spark):
    windows = spark.createDataFrame([(k, 15 * s, "ACGT"[k % 4 :] * s or None) for k in range(12) for s in range(5)], "id int, start int, sequence string")
    folds = {"n": F.length, "gc": lambda s: F.regexp_count(s, F.lit("[GC]"))}
    done = windows.where("(id + start) % 2 = 0").select("id", "start", F.lit("gc").alias("mfe_method")).union(windows.where("id = 3").selectExpr("id", "start", "'other'"))
    done = done.union(spark.createDataFrame([(None, 15, "n"), (2, 15, "n"), (2, 15, "n")], "id int, start int, m string"))
    want = {(r.id, r.start, m): len(r.sequence) if m == "n" else sum(c in "GC" for c in r.sequence) for r in windows.collect() if r.sequence is not None for m in folds}
    assert {(r.id, r.start, r.mfe_method): r.mfe for r in nulls.landscape_fold(windows, folds).collect()} == want
    for r in done.collect():
        want.pop((r.id, r.start, r.mfe_method), None)
    got = nulls.landscape_fold(windows, folds, done)
    assert {(r.id, r.start, r.mfe_method): r.mfe for r in got.collect()} == want and got.count() == len(want)
    join = plan(registry.QUERIES["g3_landscape_fold"](spark, SF)).split("Join")[1].split("Exchange")
    assert not any("sequence" in x.split("arguments", 1)[0][:200] for x in join[1:])


def test_stack_sums(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGTNé") for _ in range(rng.randrange(12))) for _ in range(200)] + ["", None, "A", "GC"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").repartition(3)
    assert all(r.a == r.b for r in rows.select(S.stack_energy(F.col("s")).alias("a"), nulls.stack_sums(F.col("s")).alias("b")).collect())


def test_best_of_blocks_against_shared_words(spark, monkeypatch):
    """Blocks and parts of any size give what rows of words give; equal words in many texts, ties and odd letters among them."""
    rng = random.Random(10)
    words = ["".join(rng.choice("ACGT") for _ in range(7)) for _ in range(12)]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["A" * 40, "A" * 25, "AT" * 15, "TA" * 12, "NNNNNNNNé", "xNNNNNNNNé", "ACG", "", None]
    df = spark.createDataFrame([(k * 5 % 41, x) for k, x in enumerate(texts)], "id int, sequence string").repartition(3)
    q = df.where("id % 3 = 0")
    once = df.dropDuplicates(["id"]).cache()
    for block, heavy in ((10**9, 10_000), (60, 3)):
        monkeypatch.setattr(similar, "BLOCK", block)
        monkeypatch.setattr(similar, "PART", block)
        want = similar.best_targets(similar.shared_words(q, df, 5), 4).select("q", "t", "score", "rank")
        assert sorted(map(tuple, similar.best_of_blocks(q, df, 5, 4, rows=heavy).collect())) == sorted(map(tuple, want.collect()))
        own = once.where("id % 3 = 0")
        want = similar.longest_runs(similar.best_targets(similar.shared_words(own, once, 5), 4), own, once, 5)
        got = similar.similar_sequences(own, once, 5, 4, heavy=heavy)
        assert set(got.columns) == set(want.columns)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_longest_stretch_both_ways():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randrange(3, 40))) for _ in range(2))
        assert similar._stretch(a, b, 3) == similar._stretch(a, b, 3, most=0)
    names, parts = [f"w{k}" for k in range(5)], "ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy"  # words too long for one number
    long_ = ["".join(rng.choice(parts) for _ in range(30)) for _ in range(5)]
    got = similar._block_best(["q"], [long_[2] + long_[3]], names, long_, 20, 3, {"A": 1})
    assert {(q, t) for q, t, _ in got} == {("q", "w2"), ("q", "w3")}


def test_md5_heads():
    heads, tails = ["", "7|1|2|", "7|123456789|30000|", "é|", "x" * 53, "x" * 60], ["", "1|0", "10|15"]
    for two, n in ((False, 7), (True, 13)):
        want = [[int(hashlib.md5((h + x).encode()).hexdigest()[:n], 16) for x in tails] for h in heads]
        assert nulls.md5_heads(heads, tails, two, 4).tolist() == want


def test_iterations_drawn_at_once(spark):
    rng = random.Random(12)
    rows = [(k, 3 * k, "".join(rng.choice("ACGT") for _ in range(rng.randrange(60)))) for k in range(40)] + [(90, 1, ""), (91, 1, None), (92, 1, "ACNTGATAéAC")]
    windows = spark.createDataFrame(rows, "id long, start int, sequence string").repartition(3)
    fanned = nulls.fan_out(windows.where("sequence is not null"), 7)
    seeds_ = (F.lit(7), F.col("id"), F.col("start"), F.col("iteration"))
    for made, one in ((nulls.doublet_iterations, nulls.drawn_doublets), (nulls.same_slot_iterations, nulls.same_slot_protein)):
        want = fanned.select("id", "start", "iteration", one(F.col("sequence"), *seeds_).alias("shuffled"))
        got = made(windows, ["id", "start"], 7)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_doublets_are_drawn_without_copies_of_windows(spark):
    text = plan(registry.QUERIES["r8_drawn_doublets"](spark, SF))
    assert "MapInArrow" in text and "md5(" not in text


def test_walks_taken_together(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("ACGT"[: 1 + k % 4]) for _ in range(rng.choice((3, 4, 9, 30)))) for k in range(400)]
    texts += ["A" * 30 + "C", "C" + "A" * 300 + "CG" + "T" * 9, "", "A", "AC", None, "ACNNA", "ACGéGCA", "GTGTGTGTGT"]
    seeds_ = [f"7|{k}" for k in range(len(texts))]
    want = [None if t is None else nulls.euler_walk(t, s) for t, s in zip(texts, seeds_)]
    assert nulls.euler_walks(texts, seeds_) == want and nulls.euler_walks(texts, seeds_, 7) == want
    rows = spark.createDataFrame([(t,) for t in texts], "s string").repartition(3).select("s", nulls.doublet_counts(F.col("s")).alias("n")).collect()
    pairs = [a + b for a in "ACGT" for b in "ACGT"]
    assert all(r.n is None if r.s is None else r.n == [sum(r.s[k : k + 2] == p for k in range(len(r.s))) for p in pairs] for r in rows)


def test_stems_of_a_batch_against_columns(spark):
    rng = random.Random(14)
    texts = ["".join(rng.choice("ACGTU" if k % 3 else "GCN") for _ in range(rng.choice((0, 3, 9, 30, 31)))) for k in range(80)] + [None, "G" * 8 + "AAAA" + "C" * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, sequence string").repartition(3)
    for first, last in ((0, 1 << 30), (2, 9)):
        own, mates = (motifs._bits(F.col("sequence"), side) for side in (0, 1))
        want = df.select("id", F.explode(motifs._stems(own, mates, 3, 3, first, last)).alias("s")).select("id", "s.*").collect()
        got = motifs._with_stems(df, 3, 3, first, last).select("id", F.explode("__stems").alias("s")).select("id", "s.*").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20
