"""Motifs, similar sequences, targets, null models, folders, streams, slices, links and facets on small cases and hostile input."""

import itertools
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import motifs, nulls, points, signals, similar, stats, structure
from shiftlens.sources import readers
from shiftlens.sources.work import work_dir
from shiftlens.streaming import imports

PAIRS = {"AT", "TA", "CG", "GC", "GT", "TG"}


def knots(text, spacer=(5, 9), stem1=(4, 20), stem2=(4, 20), loop1=(1, 10), loop2=(0, 5), loop3=(1, 40), min_gc=0.5):
    """Every two stems, whatever longer run they are part of."""
    n = len(text)

    def stem(i, j, m):
        return all(0 <= i + k < j - k - 3 <= n - 4 and text[i + k] + text[j - k] in PAIRS for k in range(m))

    out = set()
    for i1, j1 in itertools.product(range(spacer[0], min(spacer[1], n - 1) + 1), range(n)):
        for n1 in range(stem1[0], stem1[1] + 1):
            if not stem(i1, j1, n1):
                break
            if sum(c in "GC" for c in text[i1 : i1 + n1]) < min_gc * n1:
                continue
            for i2 in range(i1 + n1 + loop1[0], i1 + n1 + loop1[1] + 1):
                for l2 in range(loop2[0], loop2[1] + 1):
                    n2 = j1 - n1 + 1 - l2 - i2
                    if stem2[0] <= n2 <= stem2[1]:
                        for j2 in range(j1 + n2 + loop3[0], min(n, j1 + n2 + loop3[1] + 1)):
                            if stem(i2, j2, n2):
                                out.add((i1, j1, n1, i2, j2, n2))
    return out


def test_motif_candidates_against_all_stems(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("GGCCAT") for _ in range(rng.choice([30, 45, 60]))) for _ in range(12)]
    texts += ["AAAAA" + "G" * 24 + "A" + "CCCC" + "C" * 24 + "AA" + "GGGG", "", "ACGT", "NNNNNNNNNNNNNNNN", None, texts[0]]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    found = motifs.motif_candidates(spark.createDataFrame(rows, "id int, sequence string, i1 string"))
    got = Counter((r.id, r.i1, r.j1, r.n1, r.i2, r.j2, r.n2) for r in found.collect())
    want = {(k, *x) for k, t in enumerate(texts) if t for x in knots(t)}
    assert set(got) == want and max(got.values()) == 1 and len(want) > 50
    long = motifs.stems_of(spark.createDataFrame([(1, "G" * 21 + "AAAA" + "C" * 21)], "id int, sequence string")).where("n > 20").collect()
    assert [(r.i, r.j, r.n) for r in long] == [(0, 45, 21)]


def test_compiled_motifs():
    stems, brackets = "11..11111111.1111...22222221111.11111111.....11...2222222.", "((..((((((((.((((...[[[[[[[)))).)))))))).....))...]]]]]]]."
    segments = motifs.compile_motif(stems, brackets)
    assert [(s.kind, s.stem, s.part, s.length) for s in segments][:5] == [("h5", "1", 1, 2), ("ss", "", 0, 2), ("h5", "1", 2, 8), ("ss", "", 0, 1), ("h5", "1", 3, 4)]
    assert [(s.kind, s.part) for s in segments if s.kind == "h3"] == [("h3", 3), ("h3", 2), ("h3", 1), ("h3", 1)]
    pairs = motifs.motif_pairs(segments)
    assert len(pairs) == 21 and pairs[0] == (0, 46) and (20, 56) in pairs
    for bad in (("11..1", "((..)"), ("11", "(("), ("1", "()")):
        with pytest.raises(ValueError):
            motifs.compile_motif(*bad)


def test_motifs_are_found_at_their_places(spark):
    two, three = ("1111.222.1111...222", "((((.[[[.))))...]]]"), ("11.222..33..222..11..33", "((.[[[..<<..]]]..))..>>")
    a, b = "GGGGAGCGACCCCAAACGC", "GCAGGGAACCAACCCAAGCAAGG"
    rows = [(1, "T" * 7 + a + "AAAA" + b, 0), (2, b, 0), (3, "", 0), (4, None, 0), (5, "GGGG", 0)]
    found = motifs.find_motifs(spark.createDataFrame(rows, "id int, mrna_seq string, start int"), {"two": two, "three": three}).collect()
    got = {(r.id, r.motif, r.start) for r in found}
    assert {(1, "two", 7), (1, "three", 30), (2, "three", 0)} <= got

    def fits(text, plan):
        return all(text[i] + text[j] in PAIRS for i, j in motifs.motif_pairs(motifs.compile_motif(*plan)))

    want = {(k, m, p) for k, t, _ in rows if t for m, plan in (("two", two), ("three", three)) for p in range(len(t) - len(plan[0]) + 1) if fits(t[p : p + len(plan[0])], plan)}
    assert got == want and all(r.sequence == rows[r.id - 1][1][r.start :][: len(r.sequence)] for r in found)


def test_similar_sequences(spark):
    rng = random.Random(2)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    texts = [dna(60) for _ in range(6)] + [None, "", "ACGT"]
    texts += [texts[0][10:40] + dna(20), texts[1], "AC" * 30, "A" * 50]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "id int, sequence string, word string, n int")
    q = df.where("id in (0, 1, 2, 6, 7, 11, 12)")
    got = {(r.q, r.t): r for r in similar.similar_sequences(q, df, 6, 4, heavy=2).collect()}
    kmers = [Counter(t[i : i + 6] for i in range(len(t) - 5)) if t else Counter() for t in texts]
    for a in (0, 1, 2, 6, 7, 11, 12):
        scored = [(-30 * sum((kmers[a] & kmers[b]).values()), b) for b in range(len(texts)) if kmers[a] & kmers[b]]
        assert [b for _, b in sorted(scored)[:4]] == [b for _, b in sorted((r.rank, r.t) for (x, _), r in got.items() if x == a)]
        for b in range(len(texts)):
            if (a, b) in got:
                r = got[a, b]
                assert (r.words, r.places) == (len(kmers[a] & kmers[b]), sum(kmers[a][w] * kmers[b][w] for w in kmers[a]))
                longest = max(k for i in range(len(texts[a])) for j in range(len(texts[b])) for k in [next((k for k in range(60) if texts[a][i + k : i + k + 1] != texts[b][j + k : j + k + 1] or i + k >= len(texts[a])), 60)])
                assert r.length == longest and texts[a][r.q_start :][: r.length] == texts[b][r.q_start + r.diagonal :][: r.length]
    assert similar.similar_sequences(q.limit(0), df, 6).count() == 0


def test_low_complexity_is_not_squared(spark):
    df = spark.createDataFrame([(k, "A" * 3000) for k in range(3)], "id int, sequence string")
    pairs = similar.shared_words(df, df, 12)
    assert similar.word_counts(df, 12).count() == 3
    assert {(r.words, r.places, r.score) for r in pairs.collect()} == {(1, 2989**2, 2989 * 60)}
    runs = similar.longest_runs(pairs, df, df, 12).collect()
    assert len(runs) == 9 and {(r.diagonal, r.q_start, r.length) for r in runs} == {(0, 0, 3000)}


def energy(mirna, target, at, drop=4):
    """The rule in words: seed, then pair by pair towards both ends until the sum falls behind."""
    value = lambda a, b: {"GC": -3, "CG": -3, "AT": -2, "TA": -2, "GT": -1, "TG": -1}.get(a + b, 1)
    total = sum(value(mirna[k], target[at + 7 - k]) for k in range(1, 8))
    for steps in (list(zip(mirna[8:], target[:at][::-1])), list(zip(mirna[:1], target[at + 7 :]))):
        now = best = 0
        for a, b in steps:
            now += value(a, b)
            if now > best + drop:
                break
            best = min(best, now)
        total += best
    return total


def test_scored_targets(spark):
    rng = random.Random(9)
    mirnas = [(k, "".join(rng.choice("ACGU") for _ in range(22))) for k in range(6)] + [(90, None), (91, "ACG")]
    back = str.maketrans("ACGU", "UGCA")
    windows = []
    for k, m in mirnas[:6]:
        seed = m[1:8][::-1].translate(back)
        windows.append((k, "".join(rng.choice("ACGT") for _ in range(20)) + m[8:16][::-1].translate(back).replace("U", "T") + seed.replace("U", "T") + "ACG"))
    windows += [(50, None), (51, ""), windows[0]]
    rna = spark.createDataFrame([(k, s, 1) for k, s in mirnas], "mirna int, sequence string, energy int")
    win = spark.createDataFrame([(k, s, 1) for k, s in windows], "id int, sequence string, at int")
    got = Counter((r.mirna, r.id, r.at, r.energy) for r in similar.scored_targets(rna, win, None).collect())
    want = Counter()
    for k, m in mirnas[:6]:
        word = m[1:8].replace("U", "T")[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for i, w in windows:
            for at in range(len(w or "") - 6):
                if w[at : at + 7] == word:
                    want[k, i, at, energy(m.replace("U", "T"), w, at)] += 1
    assert got == want and len(want) >= 6
    kept = similar.scored_targets(rna, win)
    assert all(r.energy <= -22 for r in kept.collect())
    assert similar.at_most(kept, -25).count() == sum(n for k, n in want.items() if k[3] <= -25)
    assert similar.scored_targets(rna, win.limit(0)).count() == 0


def doublets(text):
    return Counter(a + b for a, b in zip(text, text[1:]))


def test_euler_walks():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ACGTN"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(0, 40)))
        made = nulls.euler_walk(text, str(rng.random()))
        assert doublets(made) == doublets(text) and made[:1] == text[:1] and made[-1:] == text[-1:]
    assert nulls.euler_walk("AAAAAAA", "x") == "AAAAAAA" and nulls.euler_walk("A" * 3000 + "C", "x") == "A" * 3000 + "C"
    text = "ACATAGACA"
    walks = {"".join(p) for p in itertools.permutations(text) if doublets("".join(p)) == doublets(text)}
    walks = {w for w in walks if w[0] == "A" and w[-1] == "A"}
    drawn = Counter(nulls.euler_walk(text, f"s{k}") for k in range(300 * len(walks)))
    assert set(drawn) == walks and max(drawn.values()) < 1.35 * 300 and min(drawn.values()) > 0.65 * 300
    assert nulls.euler_walk(text, "same") == nulls.euler_walk(text, "same")


def test_kept_doublets_in_columns(spark):
    df = spark.createDataFrame([(1, "ACGTTGCAACGGT"), (2, None), (3, "")], "id int, s string")
    got = {r.id: r.x for r in df.select("id", nulls.kept_doublets(F.col("s"), F.lit(7), F.col("id")).alias("x")).collect()}
    assert doublets(got[1]) == doublets("ACGTTGCAACGGT") and got[2] is None and got[3] == ""


def test_shuffles_are_even(spark):
    rows = spark.range(6000).select(S.shuffled(F.lit("ACG"), F.lit(1), F.col("id")).alias("s")).groupBy("s").count().collect()
    assert len(rows) == 6 and all(800 < r["count"] < 1200 for r in rows)


def test_folder_of_the_caller(spark):
    calls = spark.sparkContext.accumulator(0)

    def folder(text):
        calls.add(1)
        if "N" in text:
            raise ValueError("no such base")
        return -len(text) / 2, "." * len(text)

    rows = [(1, "ACGT", 0.0), (2, "ACGT", 0.0), (3, "NN", 0.0), (4, None, 0.0), (5, "GG", 0.0), (6, "", 0.0)]
    windows = spark.createDataFrame(rows, "id int, sequence string, error_ double")
    known = spark.createDataFrame([("GG", -9.0, "()")], "sequence string, mfe double, parens string")
    got = {r.id: r for r in nulls.fold_with(windows, folder, known, batch=2).collect()}
    assert calls.value == 3  # three new sequences, each once
    assert sorted(got) == [1, 2, 3, 5, 6] and got[1].mfe == got[2].mfe == -2.0 and got[1].parens == "...." and got[6].mfe == 0
    assert got[3].mfe is None and got[3].error == "ValueError: no such base" and (got[5].mfe, got[5].parens, got[5].error) == (-9.0, "()", None)
    assert nulls.fold_with(windows.limit(0), folder).count() == 0


def test_bootstrap_summary(spark):
    rows = [(1, -1.0, 2), (1, -2.0, 4), (1, None, 3), (2, -5.0, 1)]
    got = {r.id: r for r in nulls.bootstrap_summary(spark.createDataFrame(rows, "id int, mfe double, pairs int"), ["id"], ("mfe", "pairs")).collect()}
    assert (got[1].iterations, got[1].mfe_mean, got[1].mfe_sd, got[1].mfe_se, got[1].pairs_mean) == (3, -1.5, 0.71, 0.5, 3.0)
    assert got[1].mfe_values == "-2.0 -1.0" and got[2].mfe_sd is None
    windows = spark.createDataFrame([(1, "ACGTACGT"), (2, "AAAA")], "id int, sequence string")
    fold = lambda s: F.struct(S.stack_energy(s).alias("mfe"), F.regexp_count(s, F.lit("GC")).alias("pairs"))
    done = {r.id: r for r in nulls.bootstrap(windows, S.shuffled, fold, ["id"], 20).collect()}
    stacks = {r.id: r for r in nulls.bootstrap_stacks(windows, ["id"], {p: round(v * 100) for p, v in S.STACK.items()}, 20).collect()}
    for k in (1, 2):
        assert all(stacks[k][c] == done[k][c] for c in done[k].asDict())
    assert nulls.bootstrap_stacks(windows.limit(0), ["id"], {}).count() == 0
    assert done[1].iterations == 20 and len(done[1].mfe_values.split()) == 20 and done[2].mfe_sd == 0


def test_agreement_both_ways(spark):
    said = {"n": [0, 5, 5, 5, 0, 0, 5, 5, 0, 5], "h": [0, 5, 6, 0, 5, 0, 5, 0, 5, 6], "p": [0, 5, 6, 0, 0, 5, 0, 5, 5, 7]}
    rows = [(1, k, m, x) for m, xs in said.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "id int, position int, mfe_method string, partner int")
    split, compat = (structure.base_agreement(df, ["id"], ("n", "h", "p"), c).first() for c in (False, True))
    assert tuple(split[c] for c in structure.COUNTERS) == (1, 1, 1, 1, 1, 1, 1, 1, 2)
    assert (compat.n_alone, compat.hplusp, compat.hnp) == (0, 0, 4)


def test_stem_track(spark):
    structures = spark.createDataFrame([(1, "((..))."), (2, "..."), (3, "")], "id int, parens string")
    stems = structure.assign_stems(structure.parens_to_pairs(structures))
    got = {r.id: "".join(r.parsed) for r in structure.stem_track(structures, stems).collect()}
    assert got == {1: "11..11.", 2: "..."}


def test_import_twice_and_counts(spark, tmp_path):
    kinds = "id long, accession string, at timestamp"
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    add = lambda rows, t: spark.createDataFrame([(i, a, datetime.fromisoformat(t)) for i, a in rows], kinds).coalesce(1).write.mode("append").parquet(source)
    add([(1, "a"), (2, "a"), (3, "b"), (4, None)], "2024-01-01 10:00")
    stream = lambda: spark.readStream.schema(kinds).parquet(source)
    run = lambda w: w.trigger(availableNow=True).start().awaitTermination()
    ids = lambda: sorted(r.id for r in imports.imported(spark, table, spark.read.parquet(source).schema).collect())
    run(imports.import_stream(stream(), table, state))
    assert ids() == [1, 3]
    add([(9, "b"), (10, "c")], "2024-01-01 11:00")
    run(imports.import_stream(stream(), table, state))
    assert ids() == [1, 3, 10]
    # a batch that runs again, as after a lost driver, overwrites what it wrote
    imports.import_batch(spark.createDataFrame([(9, "b", datetime.fromisoformat("2024-01-01")), (10, "c", datetime.fromisoformat("2024-01-01"))], kinds), 1, table)
    assert ids() == [1, 3, 10]
    index, log = str(tmp_path / "index"), str(tmp_path / "log")
    go = lambda: run(imports.index_stream(imports.running_index(stream(), "accession", "at", "1 hour", "1 hour"), index, log))
    go()
    for hour in (12, 20, 21):
        add([(hour, "a")], f"2024-01-01 {hour}:30")
        go()
    got = {(r.since.hour, r.accession): r.n for r in imports.current_index(spark, index, "accession").collect()}
    assert got[(10, "a")] == 2 and got[(12, "a")] == got[(21, "a")] == 1 and got[(11, "c")] == 1
    query = imports.index_stream(imports.running_index(stream(), "accession", "at", "1 hour", "1 hour"), index, log).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert not held or held[-1] <= 3  # windows long past have left the state


def test_new_sites_with_a_time(spark, tmp_path):
    kinds = "id long, accession string, mrna_seq string, orf_start int, orf_stop int, at timestamp"
    spark.createDataFrame([(k, "a", "GGAAATTTACCCCCCCCC", 1, 18, datetime.fromisoformat("2024-01-01")) for k in (1, 2)], kinds).write.parquet(str(tmp_path / "in"))
    rows = imports.new_sites(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), (5,), "at")
    rows.writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("timed").count() == 1


def test_slices(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "Homo sapiens", 5), (2, "Zika virus", 6), (3, "Mus musculus", 7), (4, None, 8)], "id int, species string, pairs int")
    readers.write_by_species(df, path)
    before = {f: open(f, "rb").read() for f in map(str, (tmp_path / "t").rglob("*.parquet")) if "homo" not in f}
    fresh = df.where("id = 1").withColumn("pairs", F.lit(50)).withColumn("species_key", S.species_key(F.col("species")))
    for _ in range(2):  # a rerun writes the same
        points.replace_slice(fresh, path, "species_key")
    assert {r.id: r.pairs for r in spark.read.parquet(path).collect()} == {1: 50, 2: 6, 3: 7, 4: 8}
    assert all(open(f, "rb").read() == b for f, b in before.items())
    one = readers.scan_species(spark, path, "Homo sapiens")
    assert "PartitionFilters: [isnotnull(species_key" in one._jdf.queryExecution().toString() and len(one.inputFiles()) >= 1
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_links(spark):
    mfe = spark.createDataFrame([(5, "a", 1, 100, "m"), (7, "a", 1, 100, "m"), (8, "b", 1, 100, "m")], "id long, accession string, start int, seqlength int, mfe_method string")
    rows = [(1, "a", 1, 100, "m", 5), (2, "a", 1, 100, "m", 5), (3, "b", 1, 100, "m", 99), (4, "c", 1, 100, "m", 1), (6, None, 1, 100, "m", 1)]
    boot = spark.createDataFrame(rows, "id long, accession string, start int, seqlength int, mfe_method string, mfe_id long")
    ruled, repeats = stats.audit_links(boot, mfe)
    assert {r.id: (r.verdict, r.mfe_id) for r in ruled.collect()} == {1: ("kept", 5), 2: ("duplicate", 5), 3: ("relinked", 8), 4: ("orphan", 1), 6: ("orphan", 1)}
    assert [r.id for r in repeats.collect()] == [7]
    assert stats.audit_links(boot.limit(0), mfe)[0].count() == 0
    lost = spark.createDataFrame([(1, "a", "m", 2.0, -10.0, 1.5), (2, "a", "m", 2.0, 900.0, 1.5)], "id long, accession string, mfe_method string, zscore double, mfe_mean double, mfe_sd double")
    known = spark.createDataFrame([(5, "a", "m", -7.0, "s", 100), (4, "a", "m", -7.04, "s", 75)], "id long, accession string, mfe_method string, mfe double, species string, seqlength int")
    assert {r.id: (r.mfe_id, r.seqlength, r.verdict) for r in points.relink(lost, known).collect()} == {1: (4, 75, "linked"), 2: (None, None, "deleted")}


def test_facets(spark):
    df = spark.createDataFrame([("s", "m", -float(k)) for k in range(100)] + [("t", None, -5.0), ("t", "m", None)], "species string, mfe_method string, mfe double")
    got = stats.facet_histograms(df, [["species"], ["species", "mfe_method"]], 10).collect()
    own = {r.bin: r for r in got if r.facet == "species" and r.value == "s"}
    assert [own[k].n for k in range(10)] == [10] * 9 + [10] and own[9].score == 1.0 and own[4].percent == 10.0
    assert [(r.bin, r.n, r.score) for r in got if r.value == "t|"] == [(0, 1, 1.0)]


def test_series_of_many_points(spark):
    df = spark.range(10_500).select(F.lit("g").alias("k"), F.lit("m").alias("l"), F.col("id").alias("x"), (F.col("id") % 7).alias("y"))
    rows = sorted(signals.series_pieces(df, "k", "l", "x", "y", 1000).collect(), key=lambda r: r.piece)
    assert [r.points for r in rows] == [1000] * 10 + [500] and rows[3].first_x == 3000 and rows[10].last_x == 10_499 and rows[0].data.startswith("[[0.0,0.0],[1.0,1.0]")


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 2, None), (2, 9, "z"), (None, 1, "n")], "k int, id int, v string")
    assert {(r.k, r.id, r.v) for r in stats.first_per(df, ["k"]).collect()} == {(1, 2, None), (2, 9, "z"), (None, 1, "n")}
