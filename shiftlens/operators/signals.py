"""Reads, scores and signals along transcripts: depth, frames, normality of null models, pairings, methods that agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions import seq as S
from shiftlens.operators import seeds


def position_depth(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Reads at each place of each gene (gene, length), zeros included: hits are counted before they are joined."""
    counted = hits.groupBy("gene", "at").agg(F.count("*").alias("n"))
    dense = genes.where("length > 0").select("gene", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("at"))
    return dense.join(counted, ["gene", "at"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def frame_ratio(depth: DataFrame, key: str) -> DataFrame:
    """Totals of the three frames and the smoothed ratio of frames 0 and 1 to frame 2."""
    frames = [F.sum(F.when(F.col("frame") == k, F.col("n")).otherwise(0)).alias(f"f{k}") for k in range(3)]
    return depth.groupBy(key).agg(*frames).withColumn("ratio", F.round((F.col("f0") * 10.0 + F.col("f1") * 10 + 1) / (F.col("f2") * 10 + 1), 4))


def coverage_rpkm(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Reads for each base of a gene, and for each 1,000 bases and million reads."""
    counted = hits.groupBy("gene").agg(F.count("*").alias("reads"))
    total = counted.agg(F.sum("reads").alias("total"))
    per = counted.join(genes, "gene").crossJoin(F.broadcast(total))
    return per.select("gene", "reads", F.round(F.col("reads") / F.col("length"), 4).alias("coverage"), F.round(F.col("reads") * 1e9 / F.col("length") / F.col("total"), 3).alias("rpkm"))


def pars_scores(v1: DataFrame, s1: DataFrame) -> DataFrame:
    """log2((v1 + 1) / (s1 + 1)) of the next place (orf, position, value); 0 at the last one."""
    both = v1.withColumnRenamed("value", "v").join(s1.withColumnRenamed("value", "s"), ["orf", "position"])
    score = F.log2((F.col("v") + 1) / (F.col("s") + 1))
    return both.select("orf", "position", F.round(F.coalesce(F.lead(score).over(Window.partitionBy("orf").orderBy("position")), F.lit(0.0)), 3).alias("score"))


def ppcc(values: DataFrame, key: str, value: str) -> DataFrame:
    """Correlation of rank / (n + 1) with the normal distribution function of the standardised value."""
    stats = values.groupBy(key).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"), F.count(value).alias("__n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(value))
    rows = values.where(F.col(value).isNotNull()).withColumn("__r", rank).join(stats, key).where("__s > 0")
    return rows.groupBy(key).agg(F.round(F.corr(F.col("__r") / (F.col("__n") + 1), S.normal_cdf((F.col(value) - F.col("__m")) / F.col("__s"))), 4).alias("ppcc"))


def value_histogram(values: DataFrame, key: str, value: str) -> DataFrame:
    """floor(2 * n^(2/5)) equal bins between the ends of each key's values: count and share."""
    ends = values.groupBy(key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("__n"))
    at = values.where(F.col(value).isNotNull()).join(ends, key).withColumn("__b", F.floor(2 * F.pow("__n", F.lit(0.4))))
    bin_ = F.when(F.col("__hi") > F.col("__lo"), F.least(F.col("__b") - 1, F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.col("__b")))).otherwise(0).cast("int")
    out = at.groupBy(key, bin_.alias("bin")).agg(F.count("*").alias("n"), F.first("__n").alias("__n"))
    return out.select(key, "bin", "n", F.round(F.col("n") / F.col("__n"), 4).alias("share"))


def mutual_information(aligned: DataFrame) -> DataFrame:
    """Bits shared by each two columns of aligned sequences (id, sequence): pairs of columns of one row only, then counts."""
    bases = aligned.select("id", F.posexplode(F.split("sequence", "")).alias("p", "b")).where("b <> ''")
    joint = bases.alias("x").join(bases.alias("y"), F.expr("x.id = y.id and x.p < y.p")).selectExpr("x.p as c1", "y.p as c2", "x.b as b1", "y.b as b2")
    n = joint.groupBy("c1", "c2", "b1", "b2").agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy("c1", "c2", *c))
    term = F.col("n") / over() * F.log2(F.col("n") * over() / (over("b1") * over("b2")))
    return n.withColumn("t", term).groupBy("c1", "c2").agg(F.round(F.sum("t"), 4).alias("bits"))


def column_composition(aligned: DataFrame) -> DataFrame:
    """(column, base, n, share) of aligned sequences (id, sequence); columns from 0, a gap is a letter like others."""
    bases = aligned.select(F.posexplode(S.letters(F.col("sequence"))).alias("column", "base"))
    n = bases.groupBy("column", "base").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("column"))  # one row for each letter
    return n.withColumn("share", F.round(F.col("n") / total, 4))


def column_pairs(aligned: DataFrame) -> DataFrame:
    """(c1, c2, b1, b2, n, joint, ratio) for columns c1 < c2: how often two bases stand there together, the share of that, and its
    ratio to what the columns' own shares would give. Pairs are made in a sequence's row and counted before they are shuffled."""
    own = S.letters(F.col("sequence"))

    def pairs(b):
        later = lambda x, i: F.transform(F.slice(b, i + 2, F.size(b)), lambda y, k: F.struct(i.alias("c1"), (i + 1 + k).alias("c2"), x.alias("b1"), y.alias("b2")))
        return F.flatten(F.transform(b, later))

    n = aligned.select(F.explode(S.let(own, pairs)).alias("p")).select("p.*").groupBy("c1", "c2", "b1", "b2").agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy("c1", "c2", *c))
    return n.withColumn("joint", F.round(F.col("n") / over(), 4)).withColumn("ratio", F.round(F.col("n") * over() / (over("b1") * over("b2")), 4))


def histogram_with_normal(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, bin, n, share, expected, mean, variance, sd): floor(2 * n^(2/5)) equal bins between the ends of each key's values, beside the
    mass that a normal distribution of the same mean and deviation has there. Keys whose values are all equal have no row; bins
    without values none either. Moments are one row a key, joined back."""
    own = values.where(F.col(value).isNotNull())
    moments = own.groupBy(key).agg(
        F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count("*").alias("__n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("sd")
    ).where("__hi > __lo").withColumn("__b", F.floor(2 * F.pow("__n", F.lit(0.4))))
    width = (F.col("__hi") - F.col("__lo")) / F.col("__b")
    bin_ = F.least(F.col("__b") - 1, F.floor((F.col(value) - F.col("__lo")) / width)).cast("int")
    counted = own.join(moments, key).groupBy(key, bin_.alias("bin")).agg(F.count("*").alias("n")).join(moments, key)
    at = lambda k: S.normal_cdf((F.col("__lo") + width * (F.col("bin") + k) - F.col("mean")) / F.col("sd"))
    figures = {"share": F.col("n") / F.col("__n"), "expected": at(1) - at(0), "mean": F.col("mean"), "variance": F.col("variance"), "sd": F.col("sd")}
    return counted.select(key, "bin", "n", *[F.round(c, 4).alias(name) for name, c in figures.items()])


def inverted_repeats(windows: DataFrame, k: int = 8, min_loop: int = 3, max_span: int = 90) -> DataFrame:
    """(id, i, j): a k-mer at i whose reverse complement lies at j, a loop of min_loop at least between; equi-join on (id, word)."""
    words = windows.select("id", F.posexplode(S.kmers(F.col("sequence"), k)).alias("i", "word"))
    other = words.select("id", F.col("i").alias("j"), S.reverse_complement(F.col("word")).alias("word"))
    return words.join(other, ["id", "word"]).where((F.col("j") - F.col("i") >= k + min_loop) & (F.col("j") + k - F.col("i") <= max_span)).select("id", "i", "j")


def mirna_targets(mirnas: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows that hold the reverse complement of a microRNA's bases 2 to 8: (mirna, id, at). Windows are looked through once for all
    seeds; a place then becomes a row for each microRNA of its seed."""
    own = mirnas.select("mirna", S.reverse_complement(F.substring("sequence", 2, 7)).alias("word")).where("length(word) = 7")
    places = seeds.word_places(windows.select("id", F.col("sequence").alias("w")), own).select("id", "at", "word")
    return seeds.for_each_member(places, own, "word", "mirna", "id").select("mirna", "id", "at")


def agreement(edges: DataFrame, methods: list[str]) -> DataFrame:
    """Pairs (id, i, j, mfe_method): how many pairs of each structure one, two or all methods predict."""
    said = edges.where(F.col("mfe_method").isin(methods)).groupBy("id", "i", "j").agg(F.countDistinct("mfe_method").alias("k"))
    return said.groupBy("id").agg(*[F.count(F.when(F.col("k") == n, 1)).alias(f"by_{n}") for n in range(1, len(methods) + 1)])


def compare_energies(mfe: DataFrame, methods: list[str]) -> DataFrame:
    """Least energy of each window by method, side by side."""
    return mfe.groupBy("accession", "start", "seqlength").agg(*[F.round(F.min(F.when(F.col("mfe_method") == m, F.col("mfe"))), 4).alias(m) for m in methods])


def unlike_previous(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value isn't equal to, or the end of, the value before it in its group."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__before", before).where("__before is null or not endswith(__before, %s)" % value).drop("__before")


def refresh(df: DataFrame, current: DataFrame, key: str, column: str) -> DataFrame:
    """The column taken from the current table where it knows the key."""
    return df.join(current.select(key, F.col(column).alias("__new")), key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Incoming rows whose keys are new, one (with the least `by`) for each."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    return fresh.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("__r = 1").drop("__r")


def to_bpseq(structures: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, position, partner), 1-based, partner 0 where unpaired, for structures (id, parens)."""
    places = structures.select("id", F.explode(F.sequence(F.lit(1), F.length("parens"))).alias("position"))
    both = edges.select("id", F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e"))
    both = both.select("id", (F.col("e.a") + 1).alias("position"), (F.col("e.b") + 1).alias("partner"))
    return places.join(both, ["id", "position"], "left").withColumn("partner", F.coalesce("partner", F.lit(0)))


def to_ct(structures: DataFrame, edges: DataFrame, prefix: str = "") -> DataFrame:
    """(id, position, base, before, after, partner): the rows of a connect table, 1-based, partner 0 where unpaired and after 0 at the
    end, for structures (id, sequence, parens). A prefix (a slippery site) stands unpaired in front and shifts all places."""
    shift = len(prefix)
    whole = structures.select("id", F.concat(F.lit(prefix), "sequence").alias("__w"))
    places = whole.select("id", F.posexplode(S.letters(F.col("__w"))).alias("k", "base"), F.length("__w").alias("n"))
    ends = lambda a, b: F.struct((F.col(a) + 1 + shift).alias("position"), (F.col(b) + 1 + shift).alias("partner"))
    mates = edges.select("id", F.explode(F.array(ends("i", "j"), ends("j", "i"))).alias("e")).select("id", "e.*")
    rows = places.select("id", (F.col("k") + 1).alias("position"), "base", F.col("k").alias("before"), F.when(F.col("k") + 1 < F.col("n"), F.col("k") + 2).otherwise(0).alias("after"))
    return rows.join(mates, ["id", "position"], "left").select("id", "position", "base", "before", "after", F.coalesce("partner", F.lit(0)).alias("partner"))


def connect_table(structures: DataFrame, prefix: str = "") -> DataFrame:
    """The rows of to_ct for structures (id, sequence, partners) that have each base's partner in an array, 1-based, 0 for none
    (structure.with_partners). Rows are made from the structure's own: no shuffle."""
    shift = len(prefix)
    letters = S.letters(F.concat(F.lit(prefix), "sequence"))

    def rows(own):
        mate = lambda k: F.coalesce(F.get("partners", k - shift), F.lit(0))
        return F.transform(own, lambda base, k: F.struct(
            (k + 1).alias("position"), base.alias("base"), k.alias("before"), F.when(k + 1 < F.size(own), k + 2).otherwise(0).alias("after"),
            F.when(mate(k) > 0, mate(k) + shift).otherwise(0).alias("partner"),
        ))

    return structures.select("id", F.explode(S.let(letters, rows)).alias("r")).select("id", "r.*")


def series_json(df: DataFrame, key: str, label: str, x: str, y: str) -> DataFrame:
    """[{label, data: [[x, y], ...]}] for each key, by x."""
    points = df.groupBy(key, label).agg(F.transform(F.array_sort(F.collect_list(F.struct(x, y))), lambda p: F.array(p[x].cast("double"), p[y].cast("double"))).alias("data"))
    return points.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "data")))).alias("series"))


def series_pieces(df: DataFrame, key: str, label: str, x: str, y: str, size: int = 1000) -> DataFrame:
    """(key, label, piece, first_x, last_x, points, data): each series by x, cut into pieces of at most `size` points, data as JSON
    [[x, y], ...]. Points with equal x are ordered by y; nulls are left out. Places are counted as the sorted points stream by, so
    a series of any length never is one row."""
    order = Window.partitionBy(key, label).orderBy(x, y)
    placed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__p", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    grouped = placed.groupBy(key, label, F.col("__p").alias("piece")).agg(F.array_sort(F.collect_list(point)).alias("__d"))
    data = F.to_json(F.transform("__d", lambda p: F.array(p["x"], p["y"])))
    return grouped.select(key, label, "piece", F.col("__d")[0]["x"].alias("first_x"), F.element_at("__d", -1)["x"].alias("last_x"), F.size("__d").alias("points"), data.alias("data"))


def binned_frame_counts(hits: DataFrame, ranges: list[tuple[int, int]], keys: list[str] = (), shift: int = 15) -> DataFrame:
    """Reads whose shifted place lies in each range (both ends inclusive), in all and by frame: 0, +1 (place + 1 divisible by 3), -1.

    Places are counted before they meet the ranges, which are literals; ranges may overlap, and one without reads has no row."""
    counted = hits.groupBy(*keys, (F.col("at") + shift).alias("__at")).agg(F.count("*").alias("__n"))
    bins = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ranges])
    met = counted.withColumn("__b", F.explode(F.filter(bins, lambda b: F.col("__at").between(b["lo"], b["hi"]))))
    frame = F.pmod(F.col("__at"), F.lit(3))
    sums = [F.sum(F.when(frame == k, F.col("__n")).otherwise(0)).alias(name) for name, k in (("zero", 0), ("plus", 2), ("minus", 1))]
    return met.groupBy(*keys, F.col("__b.lo").alias("lo"), F.col("__b.hi").alias("hi")).agg(F.sum("__n").alias("total"), *sums)


#: The ranges of a profile by hundreds and around a signal.
PROFILE_RANGES = [(k, k + 99) for k in range(0, 1100, 100)] + [(390, 410), (411, 430), (431, 450)]
