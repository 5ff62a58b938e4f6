"""Species statistics, clouds, distributions, repairs and joins over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zscores(boot: DataFrame) -> DataFrame:
    """(mfe - mean) / sd to three places; a null or zero deviation counts as 1, null energies give 0."""
    sd = F.when(F.coalesce("mfe_sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("mfe_sd"))
    return boot.where("mfe is null or mfe <= 10").withColumn("zscore", F.round(F.coalesce((F.col("mfe") - F.col("mfe_mean")) / sd, F.lit(0.0)), 3))


def weed(points: DataFrame) -> DataFrame:
    return points.where("mfe > -80 and mfe < 5 and zscore > -10 and zscore < 10")


def of_methods(points: DataFrame, methods: list[str] | None = None, knots_only: bool = False) -> DataFrame:
    out = points.where(F.col("mfe_method").isin(methods)) if methods else points
    return out.where("knotp") if knots_only else out


def species_stats(points: DataFrame) -> DataFrame:
    """Moments by species, length and method for all, unknotted and knotted; genes beyond one and two deviations on energy, on z and on
    both. Two passes: moments, then thresholds joined back (a small side), all with map-side partial sums."""
    keys = ["species", "seqlength", "mfe_method"]
    part = lambda c, cond: F.when(cond, F.col(c)) if cond is not None else F.col(c)
    groups = {"all": None, "noknot": ~F.col("knotp"), "knotted": F.col("knotp")}
    moments = [F.min("mfe").alias("min_mfe"), F.max("mfe").alias("max_mfe"), F.avg("zscore").alias("avg_zscore"), F.stddev_pop("zscore").alias("stddev_zscore")]
    for name, cond in groups.items():
        moments += [F.count(part("mfe", cond)).alias(f"num_{name}"), F.avg(part("mfe", cond)).alias(f"avg_mfe_{name}"), F.stddev_pop(part("mfe", cond)).alias(f"stddev_mfe_{name}"), F.avg(part("pairs", cond)).alias(f"avg_pairs_{name}"), F.stddev_pop(part("pairs", cond)).alias(f"stddev_pairs_{name}")]
    first = points.groupBy(*keys).agg(*moments)
    low = lambda c, k: F.col(c) < F.col(f"avg_{c}") - k * F.col(f"sd_{c}")
    limits = first.select(*keys, F.col("avg_mfe_all").alias("avg_mfe"), F.col("stddev_mfe_all").alias("sd_mfe"), F.col("avg_zscore"), F.col("stddev_zscore").alias("sd_zscore"))
    marked = points.select(*keys, "accession", "mfe", "zscore", "knotp").join(limits, keys)
    flags = {}
    for k in (1, 2):
        for name, cond in (("mfe", low("mfe", k)), ("z", low("zscore", k)), ("both", low("mfe", k) & low("zscore", k))):
            flags |= {f"genes_{k}{name}": cond, f"genes_{k}{name}_knotted": cond & F.col("knotp")}
    # One row for each gene first: its flags are then summed, and no row is multiplied for distinct counts.
    per_gene = marked.groupBy(*keys, "accession").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    genes = per_gene.groupBy(*keys).agg(F.count("accession").alias("genes_hits"), *[F.count_if(F.col(n)).alias(n) for n in flags])
    return first.join(genes, keys)


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles to a fixed number of places."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def index_stats(genes: DataFrame, mfe: DataFrame) -> DataFrame:
    g = genes.groupBy("species").agg(F.count("*").alias("num_genome"))
    m = mfe.groupBy("species").agg(F.count("*").alias("num_mfe"), F.countDistinct(F.when(F.col("knotp"), F.col("accession"))).alias("num_knotted"))
    return g.join(m, "species", "full").select("species", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("num_genome", "num_mfe", "num_knotted")])


def site_counts(mfe: DataFrame) -> DataFrame:
    return mfe.groupBy("accession").agg(F.countDistinct("start").alias("sites"), F.countDistinct("id").alias("structures"))


def cloud_density(points: DataFrame) -> DataFrame:
    """Counts at (mfe in tenths, z in hundredths), with knotted ones and the share of the largest count."""
    at = [F.floor(F.col("mfe") * 10).alias("mfe10"), F.floor(F.col("zscore") * 100).alias("z100")]
    dense = points.groupBy(*at).agg(F.count("*").alias("n"), F.sum(F.col("knotp").cast("long")).alias("knotted"), F.countDistinct("accession").alias("genes"))
    return dense


def cloud_averages(points: DataFrame) -> DataFrame:
    out = points.groupBy("species").agg(F.avg("mfe").alias("avg_mfe"), F.stddev_pop("mfe").alias("sd_mfe"), F.avg("zscore").alias("avg_z"), F.stddev_pop("zscore").alias("sd_z"))
    return out


def distribution(points: DataFrame, column: str, bins_per_unit: int) -> DataFrame:
    """Counts by bin number floor(column * bins_per_unit), knotted and not, empty bins between the ends filled with zero; nulls count
    nowhere. The two ends are read first, so that bins are dealt over tasks."""
    own = points.where(F.col(column).isNotNull())
    binned = own.select(F.floor(F.col(column) * bins_per_unit).alias("bin"), "knotp").groupBy("bin").agg(F.count_if(~F.col("knotp")).alias("unknotted"), F.count_if("knotp").alias("knotted"))
    ends = own.agg(F.floor(F.min(column) * bins_per_unit).alias("lo"), F.floor(F.max(column) * bins_per_unit).alias("hi")).first()
    lo, hi = (0, -1) if ends.lo is None else (ends.lo, ends.hi)
    grid = points.sparkSession.range(lo, hi + 1).select(F.col("id").alias("bin"))
    return grid.join(binned, "bin", "left").select("bin", F.coalesce("unknotted", F.lit(0)).alias("unknotted"), F.coalesce("knotted", F.lit(0)).alias("knotted"))


def significant_by(points: DataFrame, key: str) -> DataFrame:
    """Total, significant (a deviation below the mean on both axes) and per cent, by a key; limits by species."""
    joined = points.join(F.broadcast(cloud_averages(points)), "species")
    hit = (F.col("mfe") <= F.col("avg_mfe") - F.col("sd_mfe")) & (F.col("zscore") <= F.col("avg_z") - F.col("sd_z"))
    out = joined.groupBy(key).agg(F.count("*").alias("total"), F.sum(hit.cast("long")).alias("significant"))
    return out.withColumn("percent", F.round(100.0 * F.col("significant") / F.col("total"), 2))


def facet_histogram(points: DataFrame, facets: list[str], bins: int = 50) -> DataFrame:
    """Counts of energies in equal bins between each facet's ends; per cent within the facet."""
    w = Window.partitionBy(*facets)
    ends = points.groupBy(*facets).agg(F.min("mfe").alias("lo"), F.max("mfe").alias("hi"), F.count("*").alias("total"))
    at = points.select(*facets, "mfe").join(ends, facets)
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("mfe") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("int")
    return at.groupBy(*facets, bin_.alias("bin")).agg(F.count("*").alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(w), 3))


def facet_histograms(points: DataFrame, sets: list[list[str]], bins: int = 50) -> DataFrame:
    """(facet, value, bin, n, percent, score) of energies for several facets at once: sets of columns, such as [species], [mfe_method],
    [knotp] or all of them. Bins are equal between the ends of a facet's value; percent is of that value's rows; score is the share of
    these up to the bin's end, as a rank, cut after four places.

    Rows are spread over the facets once, and counted before they are shuffled; ends are one row for each value of a facet. Null
    values are a value of their own (an empty string), null energies count nowhere."""
    value = lambda cols: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    facets = F.array(*[F.struct(F.lit("|".join(cols)).alias("facet"), value(cols).alias("value")) for cols in sets])
    rows = points.where(F.col("mfe").isNotNull()).select("mfe", F.explode(facets).alias("f")).select("f.facet", "f.value", "mfe")
    ends = rows.groupBy("facet", "value").agg(F.min("mfe").alias("lo"), F.max("mfe").alias("hi"), F.count("*").alias("total"))
    share = (F.col("mfe") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor(share * bins))).otherwise(0).cast("int")
    counted = rows.join(ends, ["facet", "value"]).groupBy("facet", "value", "total", bin_.alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("facet", "value").orderBy("bin"))  # at most `bins` rows a value
    return counted.select(
        "facet", "value", "bin", "n", F.round(100.0 * F.col("n") / F.col("total"), 3).alias("percent"), (F.floor(upto * 10000 / F.col("total")) / 10000).alias("score")
    )


def audit_links(boot: DataFrame, mfe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What reconnecting does to each null model, and which predictions are repeats.

    The first result is boot with verdict and mfe_id set: kept (mfe_id was right), relinked (another prediction of the same
    accession, start, seqlength and method; the least id), orphan (there is none), duplicate (another null model of that key has a
    lesser id). Rows with a null in the key are orphans. The second one is the predictions that repeat a key of a lesser id.
    Rows to keep are those kept and relinked; the others are what is deleted. Each side is aggregated by key before it is joined."""
    keys = ["accession", "start", "seqlength", "mfe_method"]
    best = mfe.groupBy(*keys).agg(F.min("id").alias("__mfe"))
    first = boot.groupBy(*keys).agg(F.min("id").alias("__first"))
    joined = boot.join(best, keys, "left").join(first, keys, "left")
    verdict = (
        F.when(F.col("__mfe").isNull(), "orphan").when(F.col("id") > F.col("__first"), "duplicate")
        .when(F.col("mfe_id").eqNullSafe(F.col("__mfe")), "kept").otherwise("relinked")
    )
    out = joined.withColumn("verdict", verdict).withColumn("mfe_id", F.coalesce("__mfe", "mfe_id"))
    repeats = mfe.join(best, keys).where(F.col("id") > F.col("__mfe")).drop("__mfe")
    return out.select(*boot.columns, "verdict"), repeats.select(*mfe.columns)


def first_per(df: DataFrame, keys: list[str], by: str = "id") -> DataFrame:
    """The row with the least `by` of each key: a partial aggregate, no sort."""
    best = df.groupBy(*keys).agg(F.min(F.struct(by, *[c for c in df.columns if c not in (*keys, by)])).alias("__r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("keep")).where("n > 1")


def reconnect(boot: DataFrame, mfe: DataFrame) -> DataFrame:
    """boot with mfe_id set by (accession, start, seqlength, method); orphans are gone, ties go to the least id."""
    keys = ["accession", "start", "seqlength", "mfe_method"]
    return boot.drop("mfe_id").join(mfe.groupBy(*keys).agg(F.min("id").alias("mfe_id")), keys)


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return inputs.join(done.select(*keys), keys, "left_anti")


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    return df.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])))


def null_census(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1)).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "blank")


def score_bands(df: DataFrame, score: str, bands: int = 10, buckets: int = 1024) -> DataFrame:
    """Band floor(rank share * bands) of each row among its species: exact ranks by counts of distinct scores. Scores are dealt over equal
    buckets between their species' ends; rows before a bucket come from the buckets' totals (at most `buckets` a species), and
    those within it from a window over the bucket, so that no species is ranked in one task. Null scores have no band and no row."""
    counts = df.where(F.col(score).isNotNull()).groupBy("species", score).agg(F.count("*").alias("__n"))
    ends = counts.groupBy("species").agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"), F.sum("__n").alias("__total"))
    share = (F.col(score) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0))
    dealt = counts.join(ends, "species").withColumn("__b", F.coalesce(F.least(F.lit(buckets - 1), F.floor(share * buckets)), F.lit(0)))
    whole = Window.partitionBy("species").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dealt.groupBy("species", "__b").agg(F.sum("__n").alias("__m")).withColumn("__before", F.coalesce(F.sum("__m").over(whole), F.lit(0))).drop("__m")
    own = Window.partitionBy("species", "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__before") + F.coalesce(F.sum("__n").over(own), F.lit(0))
    ranked = dealt.join(earlier, ["species", "__b"]).select("species", score, F.floor(before * bands / F.col("__total")).cast("int").alias("band"))
    return df.join(ranked, ["species", score])


def binned_range_join(points: DataFrame, spans: DataFrame, key: str, bin_size: int = 4096) -> DataFrame:
    """points (key, at, at_end) inside spans (key, lo, hi): spans are exploded over bins, so the join is an equi-join on (key, bin)."""
    bins = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lo") / bin_size), F.floor(F.col("hi") / bin_size))))
    return points.withColumn("__bin", F.floor(F.col("at") / bin_size)).join(bins, [key, "__bin"]).where("lo < at and at_end < hi").drop("__bin")


def text_search(df: DataFrame, query: str, column: str = "comment", species: str | None = None) -> DataFrame:
    """Boolean search: +must, -not, word, prefix*, "phrase"; with no + term some plain term has to match. Of one species where it is
    given."""
    import re

    df = df if species is None else df.where(F.col("species") == species)

    words = F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}_]+")

    def term(t: str) -> Column:
        if t.startswith('"'):
            return F.lower(F.col(column)).contains(t.strip('"').lower())
        if t.endswith("*"):
            return F.exists(words, lambda w: w.startswith(t[:-1].lower()))
        return F.array_contains(words, t.lower())

    parts = re.findall(r'([+-]?)("[^"]*"|\S+)', query)
    must, never, some = ([term(t) for s, t in parts if s == sign] for sign in ("+", "-", ""))
    keep = F.lit(True)
    for c in must:
        keep = keep & c
    for c in never:
        keep = keep & ~c
    if some and not must:
        any_ = some[0]
        for c in some[1:]:
            any_ = any_ | c
        keep = keep & any_
    return df.where(F.coalesce(keep, F.lit(False)))


def contained_counts(spots: DataFrame, spans: DataFrame, key: str, value: str, length: int, scale: int = 4096) -> DataFrame:
    """(value, n): how many spots (key, at), each of at and the `length` places behind it, lie within each span (value, key, lo, hi), both
    its ends left out. Spans that hold none have no row; nulls meet nothing; a value with several spans has their sum.

    No spot meets a span. Spots are counted by place; a running sum over a key's places and the spans' ends gives each end what lies
    before it, and a span has the difference of its two. The sum runs within stretches of `scale` places, and over
    the stretches' totals, so a key is dealt over as many tasks as it has stretches."""
    counted = spots.where("at is not null").groupBy(key, F.col("at").cast("long").alias("at")).agg(F.count("*").alias("n"))
    inside = spans.select(value, key, (F.col("lo") + 1).cast("long").alias("first"), (F.col("hi") - length).cast("long").alias("stop")).where("first < stop")
    end = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("sign"))
    ends = inside.select(value, key, F.explode(F.array(end("first", -1), end("stop", 1))).alias("e")).select(key, "e.at", F.lit(0).cast("long").alias("n"), value, "e.sign")
    places = counted.select(key, "at", "n", F.lit(None).cast(dict(spans.dtypes)[value]).alias(value), F.lit(None).cast("int").alias("sign"))
    both = places.unionByName(ends).where(F.col(key).isNotNull()).withColumn("__s", F.floor(F.col("at") / scale))
    # What lies before an end: an end at a place does not count the spots there.
    near = F.sum("n").over(Window.partitionBy(key, "__s").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    here = both.withColumn("__near", F.coalesce(near, F.lit(0))).where("sign is not null")
    totals = counted.groupBy(key, F.floor(F.col("at") / scale).alias("__s")).agg(F.sum("n").alias("n"))
    stretches = both.select(key, "__s").distinct().join(totals, [key, "__s"], "left")
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    base = stretches.select(key, "__s", F.coalesce(upto, F.lit(0)).alias("__base"))
    summed = here.join(base, [key, "__s"]).groupBy(value).agg(F.sum(F.col("sign") * (F.col("__near") + F.col("__base"))).alias("n"))
    return summed.where("n > 0")
