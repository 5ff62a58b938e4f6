"""Motifs behind slippery sites, the surroundings of an ORF's ends, tracks of annotated bases, and tables of microRNAs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions import seq as S

ARMS = ("mature", "star", "fivep", "threep")


def orf_context(genome: DataFrame) -> DataFrame:
    """Five bases from the ORF's start, twenty from its stop codon, and the codons that the -1 frame reads on from there.

    start and stop are 0-based; alt_length counts from two bases behind the stop codon's first base up to the next stop or the end."""
    start, stop = F.col("orf_start") - 1, F.col("orf_stop") - 3
    ends = S.let(S.stop_marks(S.codons(F.substring("mrna_seq", stop + 3, F.length("mrna_seq")))), lambda m: F.when(F.array_position(m, "*") > 0, F.array_position(m, "*") - 1).otherwise(F.size(m)))
    return genome.where("orf_stop >= 3").select(
        "accession", start.alias("start"), F.substring("mrna_seq", F.col("orf_start"), F.lit(5)).alias("start_region"),
        stop.alias("stop"), F.substring("mrna_seq", stop + 1, F.lit(20)).alias("stop_region"), ends.cast("int").alias("alt_length"),
    )


def annotate_bases(genome: DataFrame, sites: DataFrame, snps: DataFrame) -> DataFrame:
    """(id, track): a letter for each base of a transcript: G start codon, R stop codon, B slippery site, O first stop of the -1 frame
    behind a site, S variant, a dot elsewhere; a later kind covers an earlier one.

    Sites are (id, start, bp_mstop), variants (accession, position). Only labelled bases are shuffled; gaps are filled as text."""
    span = lambda at, n: F.sequence(at, at + (n - 1))
    codons = genome.select("id", F.explode(F.array(F.struct(F.lit(1).alias("k"), span(F.col("orf_start"), 3).alias("p")), F.struct(F.lit(2).alias("k"), span(F.col("orf_stop") - 2, 3).alias("p")))).alias("x"))
    slips = sites.select("id", F.explode(F.array(F.struct(F.lit(3).alias("k"), span(F.col("start"), 7).alias("p")), F.struct(F.lit(4).alias("k"), span(F.col("start") + 6 + F.col("bp_mstop"), 3).alias("p")))).alias("x"))
    labels = codons.union(slips).select("id", F.col("x.k").alias("k"), F.explode("x.p").alias("p"))
    variants = snps.join(genome.select("id", "accession"), "accession").select("id", F.lit(5).alias("k"), F.col("position").cast("int").alias("p"))
    top = labels.union(variants).where("p >= 1").groupBy("id", "p").agg(F.max("k").alias("k"))
    listed = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "k"))).alias("__l"))

    def filled(found: Column, length: Column) -> Column:
        inside = F.filter(found, lambda x: x["p"] <= length)

        def pieces(own: Column) -> Column:
            before = lambda i: F.coalesce(F.get(own, i - 1)["p"], F.lit(0))
            text = F.array_join(F.transform(own, lambda x, i: F.concat(F.repeat(F.lit("."), x["p"] - before(i) - 1), F.substring(F.lit("GRBOS"), x["k"], F.lit(1)))), "")
            return F.rpad(text, length, ".")

        return S.let(inside, pieces)

    found = genome.select("id", F.length("mrna_seq").alias("__n")).join(listed, "id", "left")
    return found.select("id", F.when(F.col("__l").isNull(), F.repeat(F.lit("."), F.col("__n"))).otherwise(filled(F.col("__l"), F.col("__n"))).alias("track"))


#: One bit for each base, and the bits of the bases that it pairs with (A-T, G-C, G-T).
BITS = {"A": (1, 8), "C": (2, 4), "G": (4, 10), "T": (8, 5)}


def _bits(sequence: Column, side: int) -> Column:
    """An array with the bit (side 0) or the partners' bits (side 1) of each base; 0 for other letters. U counts as T."""

    def bit(c: Column) -> Column:
        out = F.lit(0)
        for base, values in BITS.items():
            out = F.when(c == base, values[side]).otherwise(out)
        return out

    return F.transform(S.letters(F.translate(sequence, "U", "T")), bit)


def _stems(own: Column, mates: Column, shortest: int, min_loop: int, first: int = 0, last: int = 1 << 30) -> Column:
    """Structs i, j, n of the longest runs of nested pairs of a window, outer pair first, whose left side lies between first and last.
    Pairs i, j with the same sum lie on a diagonal; its pairs as a string of 0 and 1 show the runs. Time grows with the square of the
    window."""
    n = F.size(own)

    def runs(d: Column) -> Column:
        low = F.greatest(F.lit(first), d - n + 1)
        high = F.least(F.floor((d - min_loop - 1) / 2).cast("int"), F.lit(last))
        many = high - low + 1
        left, right = F.slice(own, low + 1, many), F.reverse(F.slice(mates, d - high + 1, many))
        marks = F.array_join(F.zip_with(left, right, lambda a, b: F.when(a.bitwiseAND(b) > 0, "1").otherwise("0")), "")
        # Each piece ends with a run. Most diagonals have none that is long enough, which is seen without a pattern.
        cut = S.let(marks, lambda m: F.when(m.contains("1" * shortest), F.regexp_extract_all(m, F.lit(f"[01]*?1{{{shortest},}}"), F.lit(0))).otherwise(S.none_of("string")))

        def stem(piece: Column, k: Column, pieces: Column) -> Column:
            size = F.length(F.regexp_extract(piece, "1+$", 0))
            i = low + F.length(F.array_join(F.slice(pieces, 1, k + 1), "")) - size
            return F.struct(i.alias("i"), (d - i).alias("j"), size.alias("n"))

        listed = S.let(cut, lambda pieces: F.transform(pieces, lambda piece, k: stem(piece, k, pieces)))
        return F.when(many >= shortest, listed).otherwise(F.array().cast("array<struct<i:int,j:int,n:int>>"))

    return F.when(n > min_loop + 1, F.flatten(F.transform(F.sequence(F.lit(min_loop + 1), 2 * n - min_loop - 3), runs)))


def stems_of(windows: DataFrame, shortest: int = 4, min_loop: int = 3) -> DataFrame:
    """(id, i, j, n): the longest runs of n nested pairs (A-T, G-C, G-T) of each window (id, sequence), with the outer pair i, j,
    0-based, and at least min_loop bases inside. Found in the row, without a shuffle; every part of a run is a stem too."""
    found = S.let(_bits(F.col("sequence"), 0), lambda own: S.let(_bits(F.col("sequence"), 1), lambda mates: _stems(own, mates, shortest, min_loop)))
    return windows.select("id", F.explode(found).alias("s")).select("id", "s.i", "s.j", "s.n")


def _with_stems(windows: DataFrame, shortest: int, min_loop: int, first: int, last: int) -> DataFrame:
    """Windows (id, sequence) with the structs of _stems as __stems; windows without any are left out. Diagonals of all windows of one
    length in an Arrow batch are looked at together."""
    bits = np.zeros((2, 256), np.uint8)
    for base, values in BITS.items():
        bits[:, ord(base)] = values
    bits[:, ord("U")] = bits[:, ord("T")]

    def of_length(texts: list[str], size: int) -> list[np.ndarray]:
        raw = np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8).reshape(-1, size)
        own, mates, found = bits[0][raw], bits[1][raw], []
        for d in range(first + min_loop + 1, 2 * size - 1):
            low, high = max(first, d - size + 1), min((d - min_loop - 1) // 2, last)
            if high - low + 1 < shortest:
                continue
            marks = np.zeros((len(raw), high - low + 3), np.int8)
            marks[:, 1:-1] = (own[:, low : high + 1] & mates[:, d - high : d - low + 1][:, ::-1]) > 0
            turns = np.diff(marks.ravel())
            begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
            n = end - begin
            begin, n = begin[n >= shortest], n[n >= shortest]
            row, i = begin // marks.shape[1], low + begin % marks.shape[1]
            found.append(np.stack((row, i, d - i, n), 1))
        return found

    def run(batches):
        for batch in batches:
            texts = batch.column("sequence").to_pylist()
            sizes = np.array([-1 if t is None else len(t) for t in texts], np.int64)
            found = [np.zeros((0, 4), np.int64)]
            for size in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == size)
                step = max(1, 50_000 // int(size))
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    for x in of_length([texts[r] for r in part], int(size)):
                        x[:, 0] = part[x[:, 0]]
                        found.append(x)
            whole = np.concatenate(found)
            whole = whole[np.argsort(whole[:, 0], kind="stable")]
            kept, begin = np.unique(whole[:, 0], return_index=True)
            stems = pa.StructArray.from_arrays([pa.array(whole[:, k], pa.int32()) for k in (1, 2, 3)], names=["i", "j", "n"])
            lists = pa.ListArray.from_arrays(pa.array([*begin, len(whole)], pa.int32()), stems)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept)) for c in ("id", "sequence")), lists], names=["id", "sequence", "__stems"])

    kind = windows.schema["id"].dataType.simpleString()
    return windows.mapInArrow(run, f"id {kind}, sequence string, __stems array<struct<i:int,j:int,n:int>>")


def motif_candidates(windows: DataFrame, spacer=(5, 9), stem1=(4, 20), stem2=(4, 20), loop1=(1, 10), loop2=(0, 5), loop3=(1, 40), min_gc: float = 0.5) -> DataFrame:
    """H-type knots in windows (id, sequence) behind a site: two stems whose sides take turns, with bounds for the spacer in front, the
    stems and the three loops, and the least share of G and C on the left side of stem 1.

    Every part of a run of nested pairs is a stem: runs stay ranges, and the bounds cut the parts out of them. All of it happens in the
    window's row: no shuffle. Windows without a candidate, with null or other letters give no row for these."""
    least, loop = min(stem1[0], stem2[0]), 3
    last = spacer[1] + stem1[1] + loop1[1] + stem2[1]  # no left side ends behind it
    rows = _with_stems(windows.select("id", "sequence"), least, loop, spacer[0], last)
    span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(S.none_of("int"))

    def parts(s: Column, first: Column, last: Column, sizes) -> Column:
        """Parts of the run s whose left side begins between first and last: sizes(i, longest) are the lengths to take."""

        def at(i: Column) -> Column:
            k = i - s["i"]
            return F.transform(sizes(i, s["n"] - k), lambda m: F.struct(i.alias("i"), (s["j"] - k).alias("j"), m.alias("n")))

        return F.flatten(F.transform(span(F.greatest(s["i"], first), F.least(s["i"] + s["n"] - 1, last)), at))

    one = F.flatten(F.transform("__stems", lambda s: parts(s, F.lit(spacer[0]), F.lit(spacer[1]), lambda i, longest: span(F.lit(stem1[0]), F.least(F.lit(stem1[1]), longest)))))
    ones = rows.withColumn("o", F.explode(one))
    gc = F.length(F.regexp_replace(F.substring("sequence", F.col("o.i") + 1, F.col("o.n")), "[^GC]", ""))
    ones = ones.where(gc >= min_gc * F.col("o.n"))
    behind, inner = F.col("o.i") + F.col("o.n"), F.col("o.j") - F.col("o.n") + 1

    def second(s: Column) -> Column:
        def sizes(i: Column, longest: Column) -> Column:
            return span(F.greatest(F.lit(stem2[0]), inner - i - loop2[1]), F.least(F.least(F.lit(stem2[1]), longest), inner - i - loop2[0]))

        return F.filter(parts(s, behind + loop1[0], behind + loop1[1], sizes), lambda t: (t["j"] - t["n"] - F.col("o.j")).between(*loop3))

    close = lambda s: (s["i"] <= behind + loop1[1]) & (s["i"] + s["n"] > behind + loop1[0]) & (s["j"] > F.col("o.j"))
    both = ones.withColumn("t", F.explode(F.flatten(F.transform(F.filter("__stems", close), second))))
    return both.select("id", F.col("o.i").alias("i1"), F.col("o.j").alias("j1"), F.col("o.n").alias("n1"), F.col("t.i").alias("i2"), F.col("t.j").alias("j2"), F.col("t.n").alias("n2"))


@dataclass(frozen=True)
class Segment:
    """A stretch of a motif: ss (single bases), or the left (h5) or right (h3) side of a part of a stem."""

    kind: str
    stem: str
    part: int
    length: int


def compile_motif(stems: str, brackets: str) -> list[Segment]:
    """Segments of a structure: stems has each base's stem letter or a dot, brackets shows the side. A stem may have several parts;
    right sides close the latest open part. A side without its counterpart, or of another length, raises ValueError."""
    if len(stems) != len(brackets):
        raise ValueError("stems and brackets differ in length")
    kind = lambda s, b: ("ss", "") if s == "." else ("h5" if b in "([{<" else "h3", s)
    out, open_ = [], {}
    for (side, stem), run in groupby(zip(stems, brackets), key=lambda x: kind(*x)):
        length = len(list(run))
        parts = open_.setdefault(stem, [])
        if side == "h5":
            parts.append((sum(s.kind == "h5" and s.stem == stem for s in out) + 1, length))
            out.append(Segment(side, stem, *parts[-1]))
        elif side == "h3":
            if not parts or parts[-1][1] != length:
                raise ValueError(f"stem {stem}: a right side of {length} bases has no left side of that length")
            out.append(Segment(side, stem, *parts.pop()))
        else:
            out.append(Segment(side, "", 0, length))
    left = [stem for stem, parts in open_.items() if parts]
    if left:
        raise ValueError(f"stems left open: {left}")
    return out


def motif_pairs(segments: list[Segment]) -> list[tuple[int, int]]:
    """The places, from the motif's start, that pair."""
    at, opened, out = 0, {}, []
    for s in segments:
        if s.kind == "h5":
            opened[s.stem, s.part] = at
        elif s.kind == "h3":
            a = opened.pop((s.stem, s.part))
            out += [(a + k, at + s.length - 1 - k) for k in range(s.length)]
        at += s.length
    return sorted(out)


def find_motifs(genome: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """(id, motif, start, sequence): where a structure's pairs can all form (A-T, G-C, G-T), start 0-based, overlapping places too.

    wanted: name -> (stem letters, brackets). A motif has any number of stems, crossing ones too, and a fixed length, so that a place is
    tried pair by pair until one fails; transcripts are read once for all motifs, without a shuffle."""
    plans = {name: (len(stems), motif_pairs(compile_motif(stems, brackets))) for name, (stems, brackets) in wanted.items()}

    def places(own: Column, mates: Column) -> Column:
        def of(name: str, length: int, pairs: list[tuple[int, int]]) -> Column:
            def fits(p: Column) -> Column:
                return reduce(lambda x, y: x & y, [F.get(own, p + a).bitwiseAND(F.get(mates, p + b)) > 0 for a, b in pairs], F.lit(True))

            starts = F.filter(F.sequence(F.lit(0), F.size(own) - length), fits)
            rows = F.transform(starts, lambda p: F.struct(F.lit(name).alias("motif"), p.alias("start"), F.lit(length).alias("length")))
            return F.when(F.size(own) >= length, rows).otherwise(F.array().cast("array<struct<motif:string,start:int,length:int>>"))

        return F.concat(*[of(name, *plan) for name, plan in plans.items()])

    found = S.let(_bits(F.col("mrna_seq"), 0), lambda own: S.let(_bits(F.col("mrna_seq"), 1), lambda mates: places(own, mates)))
    rows = genome.where("mrna_seq is not null").withColumn("__m", F.explode(found))
    return rows.select("id", "__m.motif", "__m.start", F.substring("mrna_seq", F.col("__m.start") + 1, F.col("__m.length")).alias("sequence"))


def merge_mirna(hairpin: DataFrame, mature: DataFrame) -> DataFrame:
    """One row a name of hairpins and mature sequences (name, accession, species, sequence): sequences and accessions of the hairpin
    and of four arms. `*`, `-5p` and `-3p` of a mature name tell the arm; a hairpin's copy number is cut. Of several entries for one
    place the one with the least accession, then sequence, stays."""
    name = F.lower("name")
    copy_cut = F.when(name.rlike(r"\w+-\w+-\w+-.*"), F.regexp_replace(name, r"-\d+$", "")).otherwise(name)
    arm = F.when(name.contains("*"), "star").when(name.contains("-5p"), "fivep").when(name.contains("-3p"), "threep").otherwise("mature")
    rows = hairpin.select(copy_cut.alias("__name"), F.lit("hairpin").alias("__arm"), "species", "accession", "sequence").unionByName(
        mature.select(F.regexp_replace(name, r"\*|-5p|-3p", "").alias("__name"), arm.alias("__arm"), "species", "accession", "sequence")
    )
    entry = lambda kind: F.min(F.when(F.col("__arm") == kind, F.struct("accession", "sequence")))
    kinds = ("hairpin", *ARMS)
    out = rows.groupBy("__name").agg(F.min("species").alias("species"), *[entry(k).alias(k) for k in kinds])
    return out.select(F.col("__name").alias("micro_name"), "species", *[c for k in kinds for c in (F.col(f"{k}.accession").alias(f"{k}_accession"), F.col(f"{k}.sequence").alias(k))])


def mirna_fasta(merged: DataFrame, species: str | None = None) -> DataFrame:
    """(value): a FASTA record of each arm: >name-arm, the hairpin's accession or `undefined`, the arm's accession."""
    rows = merged if species is None else merged.where(F.col("species") == species)
    label = {"mature": "mature", "star": "star", "fivep": "5p", "threep": "3p"}
    arms = F.array(*[F.struct(F.lit(label[k]).alias("arm"), F.col(f"{k}_accession").alias("acc"), F.col(k).alias("seq")) for k in ARMS])
    flat = rows.select("micro_name", F.coalesce("hairpin_accession", F.lit("undefined")).alias("hairpin"), F.explode(arms).alias("x")).where("x.seq is not null")
    head = F.concat(F.lit(">"), "micro_name", F.lit("-"), "x.arm", F.lit(" "), "hairpin", F.lit(" "), F.coalesce("x.acc", F.lit("")))
    return flat.select(F.concat(head, F.lit("\n"), "x.seq").alias("value"))


def enrich(genes: DataFrame, notes: DataFrame, columns: list[str], key: str = "accession") -> DataFrame:
    """Genes with the listed columns of their notes, where these aren't null; several notes of a key count by their greatest value."""
    best = notes.groupBy(key).agg(*[F.max(c).alias(f"__{c}") for c in columns])
    out = genes.join(best, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c) if c in genes.columns else F.col(f"__{c}")).drop(f"__{c}")
    return out


def recompute(mfe: DataFrame, fold, sequence: str = "sequence") -> DataFrame:
    """Rows whose energy differs from fold(sequence): the new energy beside the one they had (mfe_before); distinct sequences are folded once."""
    folded = mfe.select(sequence).distinct().withColumn("__new", fold(F.col(sequence)))
    out = mfe.join(folded, sequence).where(~F.col("__new").eqNullSafe(F.col("mfe")))
    return out.withColumn("mfe_before", F.col("mfe")).withColumn("mfe", F.col("__new")).drop("__new")


def change_columns(df: DataFrame, drop: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Columns dropped and renamed where the table has them, so that one change goes over the tables of all species."""
    return df.drop(*drop).withColumnsRenamed({a: b for a, b in (rename or {}).items() if a in df.columns})
