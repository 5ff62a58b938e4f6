"""Frame scans over transcripts: slippery sites, windows, alternative frames, codon tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions import seq as S


def _sites(canonical_only: bool, width: int, more=None) -> Column:
    """Structs of the in-frame slippery heptamers of a transcript: start (1-based), slipsite, `width` bases behind it, and the columns
    that `more` makes of the start. The transcript is cut into codons once; no place is found by walking the string."""
    first, second = ("AAA", "CCC", "GGG", "TTT"), ("AAA", "TTT")
    last = list("ACT" if canonical_only else "ACGT")

    def hits(codons: Column) -> Column:
        def slippery(k: Column) -> Column:
            seventh = F.substring(F.get(codons, k + 2), 1, 1)
            return F.get(codons, k).isin(*first) & F.get(codons, k + 1).isin(*second) & seventh.isin(last) & (3 * k + 9 <= F.col("orf_stop") - F.col("orf_start"))

        def site(k: Column) -> Column:
            start = F.col("orf_start") + 2 + 3 * k
            behind = F.array_join(F.slice(codons, k + 3, (width + 1) // 3 + 1), "")
            word = F.concat(F.get(codons, k), F.get(codons, k + 1), F.substring(F.get(codons, k + 2), 1, 1))
            return F.struct(start.alias("start"), word.alias("slipsite"), F.substring(behind, 2, width).alias("behind"), *(c.alias(n) for n, c in (more(start) if more else {}).items()))

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(codons) - 3), slippery), site)

    # The last piece may be a part of a codon.
    tail = F.expr("substring(mrna_seq, orf_start + 2)")
    return F.when(F.length(tail) >= 7, S.let(F.regexp_extract_all(tail, F.lit("(?s).{1,3}"), F.lit(0)), hits))


def find_slipsites(genome: DataFrame, seqlengths=(100, 75, 50), canonical_only: bool = False) -> DataFrame:
    """A row for each in-frame slippery heptamer and window length; start is 1-based in the transcript. No shuffle, and time in
    proportion to the length of the transcript."""
    sites = genome.withColumn("__site", F.explode(_sites(canonical_only, max(seqlengths))))
    sites = sites.withColumn("start", F.col("__site.start")).withColumn("slipsite", F.col("__site.slipsite")).withColumn("seqlength", F.explode(F.array(*[F.lit(n) for n in seqlengths])))
    return sites.withColumn("sequence", F.substring(F.col("__site.behind"), F.lit(1), F.col("seqlength"))).drop("__site")


def _shifted(genome: DataFrame, offsets: tuple[int, ...], make) -> DataFrame:
    """A row for each site with the columns that make(start, frame) gives; frame(offset) is the number of codons up to the first stop
    from start + offset on, and their amino acids. Sites lie in one frame, so each offset has one frame of the transcript."""
    cut = {}
    for offset in offsets:
        begin = F.pmod(F.col("orf_start") + 1 + offset, F.lit(3))
        codons = F.regexp_extract_all(F.substring("mrna_seq", begin + 1, F.length("mrna_seq")), F.lit("(?s).{3}"), F.lit(0))
        cut |= {f"codons{offset}": codons, f"begin{offset}": begin}

    def with_marks(held: Column) -> Column:
        marks = [S.stop_marks(held[f"codons{offset}"]).alias(f"marks{offset}") for offset in offsets]
        return S.let(F.struct(*marks) if marks else F.struct(F.lit(0)), lambda ends: rows(held, ends))

    def rows(held: Column, ends: Column) -> Column:
        def frame(start: Column, offset: int) -> tuple[Column, Column]:
            codons, marks = held[f"codons{offset}"], ends[f"marks{offset}"]
            k = F.floor((start + offset - 1 - held[f"begin{offset}"]) / 3).cast("int")
            stop = lambda n: F.array_position(F.slice(marks, k + 1, n), "*")
            left = F.greatest(F.size(codons) - k, F.lit(0))
            near = stop(F.lit(64))
            n = F.when(near > 0, near - 1).otherwise(F.when(stop(left) > 0, stop(left) - 1).otherwise(left)).cast("int")
            return n, F.when(n > 0, F.array_join(S.amino_letters(F.slice(codons, k + 1, n)), "")).otherwise("")

        return _sites(False, 1, lambda start: make(start, lambda offset: frame(start, offset)))

    out = genome.withColumn("__site", F.explode(S.let(F.struct(*[c.alias(n) for n, c in cut.items()]), with_marks)))
    names = [f.name for f in out.schema["__site"].dataType.fields if f.name != "behind"]
    return out.select(*[c for c in genome.columns if c != "mrna_seq"], *[F.col(f"__site.{n}").alias(n) for n in names])


def keep_coding(windows: DataFrame, do_utr: bool = False) -> DataFrame:
    """Windows of full length that start before the ORF's stop (or anywhere, with do_utr)."""
    out = windows.where(F.length("sequence") == F.col("seqlength"))
    return out if do_utr else out.where("start < orf_stop")


def num_slipsites(genome: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct sites of each accession, zero included."""
    found = windows.groupBy("accession").agg(F.countDistinct("start").alias("num_slipsite"))
    return genome.select("accession").join(found, "accession", "left").select("accession", F.coalesce("num_slipsite", F.lit(0)).alias("num_slipsite"))


def landscape_windows(genome: DataFrame, length: int = 105, step: int = 15) -> DataFrame:
    """Windows of `length` bases, one each `step`: put together from pieces of `step` bases."""

    def cut(pieces: Column) -> Column:
        piece = lambda k: F.substring(F.array_join(F.slice(pieces, k + 1, -(-length // step)), ""), 1, length)
        return F.transform(F.sequence(F.lit(0), F.floor((F.length("mrna_seq") - length) / step).cast("int")), lambda k: F.struct((k * step).alias("start"), piece(k).alias("sequence")))

    pieces = F.regexp_extract_all("mrna_seq", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    found = F.explode(F.when(F.length("mrna_seq") >= length, S.let(pieces, cut)))
    return genome.withColumn("__w", found).withColumn("start", F.col("__w.start")).withColumn("sequence", F.col("__w.sequence")).drop("__w")


def window_at(genome: DataFrame, startpos: int, length: int) -> DataFrame:
    return genome.select("id", "accession", F.lit(startpos).alias("start"), S.resolve_iupac(F.substring("mrna_seq", startpos, length)).alias("sequence"))


def alternative_orfs(genome: DataFrame) -> DataFrame:
    """Peptides after a +1 and a -1 shift at each site, up to the first stop; all-A tails give null."""
    body = F.length(F.regexp_replace("mrna_seq", "A+$", ""))

    def make(start, frame):
        out = {}
        for name, offset in (("plus", 5), ("minus", 6)):
            n, peptide = frame(offset)
            tail_of_a = (start + (offset - 1) >= F.col("__body")) & (start + (offset - 1) < F.length("mrna_seq"))
            out |= {f"{name}_orf": F.when(~tail_of_a, peptide), f"{name}_length": F.when(~tail_of_a, n)}
        return out

    return _shifted(genome.withColumn("__body", body), (5, 6), make).drop("__body")


def minus_stop_distance(genome: DataFrame) -> DataFrame:
    """Bases from each site to the first stop of the -1 frame; to the last whole codon where there is none."""
    return _shifted(genome, (6,), lambda start, frame: {"bp_mstop": 3 * frame(6)[0]})


def frameshift_protein(genome: DataFrame) -> DataFrame:
    """Zero-frame protein up to each site in lower case, then the -1 frame up to its stop."""
    protein = S.translate(F.expr("substring(mrna_seq, orf_start)"))

    def make(start, frame):
        head = F.substring(F.col("__protein"), F.lit(1), F.floor((start - F.col("orf_start") + 1) / 3).cast("int"))
        return {"fusion": F.concat(F.lower(head), frame(6)[1])}

    return _shifted(genome.withColumn("__protein", protein), (6,), make).drop("__protein")


def codon_rank(genome: DataFrame) -> DataFrame:
    """Codon counts by position and frame (0, 1, -1), poly-A tails cut."""
    body = genome.select(F.regexp_replace("mrna_seq", "A+$", "").alias("s"))
    frames = F.array(*[F.struct(F.lit(name).alias("frame"), S.codons(F.col("s"), offset).alias("codons")) for name, offset in ((0, 0), (1, 1), (-1, 2))])
    rows = body.select(F.explode(frames).alias("f")).select("f.frame", F.posexplode("f.codons").alias("position", "codon"))
    return rows.groupBy("frame", "position", "codon").agg(F.count("*").alias("n"))


def composition(genome: DataFrame) -> DataFrame:
    """Counts of bases by codon slot over all sequences."""
    rows = genome.select(F.posexplode(F.split("mrna_seq", "")).alias("p", "base"))
    return rows.where("base <> ''").groupBy((F.col("p") % 3).alias("slot"), "base").agg(F.count("*").alias("n"))


def stop_distances(genome: DataFrame) -> DataFrame:
    """How often two neighbouring in-frame stops are so many codons apart, by frame."""
    frames = F.array(*[F.struct(F.lit(k).alias("frame"), S.codons(F.col("mrna_seq"), k).alias("codons")) for k in range(3)])
    stops = genome.select("id", F.explode(frames).alias("f")).select("id", "f.frame", F.posexplode("f.codons").alias("p", "codon")).where(F.col("codon").isin("TAA", "TAG", "TGA"))
    gap = F.col("p") - F.lag("p").over(Window.partitionBy("id", "frame").orderBy("p"))
    return stops.select("frame", gap.alias("distance")).where("distance is not null").groupBy("frame", "distance").agg(F.count("*").alias("n"))


def composition_by_sequence(genome: DataFrame) -> DataFrame:
    """(id, kind, slots, key, n): bases by their place in a codon (1, 2, 3), pairs of bases of the places 1-2, 2-3, 1-3 and of the third
    and the next codon's first (3-1), and whole codons of each sequence. Bases beyond the last whole codon count nowhere."""
    codons = S.codons(F.col("mrna_seq"))
    base = lambda c, k: F.substring(c, k, 1)

    def of(own):
        def entries(c, i):
            following = F.get(own, i + 1)
            made = [("base", str(k), base(c, k)) for k in (1, 2, 3)] + [("pair", f"{a}-{b}", F.concat(base(c, a), base(c, b))) for a, b in ((1, 2), (2, 3), (1, 3))]
            made += [("pair", "3-1", F.concat(base(c, 3), base(following, 1))), ("codon", "", c)]
            return F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(slots).alias("slots"), key.alias("key")) for kind, slots, key in made])

        return F.flatten(F.transform(own, entries))

    rows = genome.select("id", F.explode(S.let(codons, of)).alias("e")).select("id", "e.*").where("key is not null")
    return rows.groupBy("id", "kind", "slots", "key").agg(F.count("*").alias("n"))


def stop_distances_by_region(genome: DataFrame) -> DataFrame:
    """(region, frame, distance, n): how often two neighbouring in-frame stops of a region (5utr, orf, 3utr) are so many codons apart.
    Each region is cut out first, so its frames count from its own first base. The stops of a frame stay in the row."""
    cut = {"5utr": F.substring("mrna_seq", F.lit(1), F.col("orf_start") - 1), "orf": F.substring("mrna_seq", F.col("orf_start"), F.col("orf_stop") - F.col("orf_start") + 1)}
    cut["3utr"] = F.substring("mrna_seq", F.col("orf_stop") + 1, F.length("mrna_seq"))
    found = [F.struct(F.lit(r).alias("region"), F.lit(k).alias("frame"), S.codons(seq, k).alias("codons")) for r, seq in cut.items() for k in range(3)]

    def gaps(codons):
        places = F.filter(F.transform(codons, lambda c, i: F.when(c.isin("TAA", "TAG", "TGA"), i)), lambda i: i.isNotNull())
        return S.let(places, lambda own: F.filter(F.transform(own, lambda p, j: F.when(j > 0, p - F.get(own, j - 1))), lambda d: d.isNotNull()))

    rows = genome.select(F.explode(F.array(*found)).alias("f")).select("f.region", "f.frame", F.explode(gaps(F.col("f.codons"))).alias("distance"))
    return rows.groupBy("region", "frame", "distance").agg(F.count("*").alias("n"))
