"""Predictions joined with null models and genes: cloud points, bars, variants by place, summaries, repairs."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.operators.stats import binned_range_join, of_methods, weed, zscores

WINDOW = ["accession", "start", "seqlength", "mfe_method"]


def cloud_points(mfe: DataFrame, boot: DataFrame, genes: DataFrame, methods: list[str] | None = None, knots_only: bool = False) -> DataFrame:
    """Predictions with the z-score of their null model and the gene's name: boot by mfe_id, genes by accession. Predictions are
    filtered before they are joined; points far off on either axis are left out."""
    wanted = of_methods(mfe, methods, knots_only)
    scored = zscores(boot.join(wanted.select(F.col("id").alias("mfe_id"), "mfe").distinct(), "mfe_id")).select("mfe_id", "zscore")
    named = genes.select("accession", "genename", "orf_start", "orf_stop")
    return weed(wanted.join(scored, wanted.id == scored.mfe_id).drop("mfe_id").join(named, "accession"))


def axis_distribution(points: DataFrame, column: str, width: float, margin: float, series: Column) -> DataFrame:
    """Counts by series in bins of `width` from the least value - margin to the greatest + margin, empty bins with zero; nulls count
    nowhere. The two ends are read first, so that bins are dealt over tasks however many an outlier asks for."""
    own = points.where(F.col(column).isNotNull())
    ends = own.agg((F.min(column) - margin).alias("lo"), (F.max(column) + margin).alias("hi")).first()
    lo, hi = (float(e) if e is not None else 0.0 for e in ends)
    at = own.select(F.floor((F.col(column) - F.lit(lo)) / width).cast("int").alias("bin"), series.alias("series"))
    counted = at.groupBy("bin", "series").agg(F.count("*").alias("n"))
    bins = points.sparkSession.range(floor((hi - lo) / width) + 1).select(F.col("id").cast("int").alias("bin"))
    grid = bins.join(counted.select("series").distinct(), F.lit(True))  # as many rows as the picture has bars
    counted = counted.select(F.col("bin").alias("__bin"), F.col("series").alias("__series"), "n")
    both = grid.join(counted, (F.col("bin") == F.col("__bin")) & F.col("series").eqNullSafe(F.col("__series")), "left")
    return both.select("bin", "series", F.coalesce("n", F.lit(0)).alias("n"))


def slipsite_family(slipsite: Column) -> Column:
    """The repeated letter that a site begins with, as RNA: AAA, UUU, CCC or GGG."""
    return F.translate(F.substring(slipsite, 1, 3), "T", "U")


def snp_classes(windows: DataFrame, snps: DataFrame, bin_size: int = 128) -> DataFrame:
    """(snp_id, mfe_id, class): s where a variant (snp_id, accession, lo, hi) touches the site's seven bases; else the least stem
    among the places it covers (parsed: stem of each base of the window, null if unpaired); else f inside the window, which
    begins behind the site. Equi-join on accession and bin of `bin_size` bases. Variants outside every window are not listed."""
    spans = windows.select("accession", F.col("id").alias("mfe_id"), "start", "seqlength", "parsed", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("start") + 6 + F.col("seqlength")) / bin_size))).alias("bin"))
    wide = snps.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / bin_size), F.floor(F.col("hi") / bin_size))))
    last = F.col("start") + 6 + F.col("seqlength")
    hits = wide.join(spans, ["accession", "bin"]).where((F.col("lo") <= last) & (F.col("hi") >= F.col("start")))
    first = F.greatest(F.col("lo") - F.col("start") - 7, F.lit(0))
    covered = F.greatest(F.least(F.col("hi"), last) - F.col("start") - 7 - first + 1, F.lit(0))
    stem = F.array_min(F.slice("parsed", (first + 1).cast("int"), covered.cast("int")))
    kind = F.when(F.col("lo") <= F.col("start") + 6, "s").otherwise(F.coalesce(stem.cast("string"), F.lit("f")))
    # A variant and a window that share two bins meet twice.
    return hits.select("snp_id", "mfe_id", kind.alias("class")).distinct()


def snp_summary(snps: DataFrame, classes: DataFrame) -> DataFrame:
    """Each variant with its class (n outside all windows; s before stems, stems before f) and the predictions it touches."""
    rank = F.when(F.col("class") == "s", -1).when(F.col("class") == "f", 1 << 30).otherwise(F.col("class").cast("int"))
    met = classes.groupBy("snp_id").agg(F.min(F.struct(rank.alias("r"), "class")).alias("best"), F.array_sort(F.collect_set("mfe_id")).alias("mfe_ids"))
    return snps.select("snp_id").join(met, "snp_id", "left").select("snp_id", F.coalesce("best.class", F.lit("n")).alias("frameshift"), F.coalesce("mfe_ids", F.array().cast("array<bigint>")).alias("mfe_ids"))


def has_snp(mfe: DataFrame, classes: DataFrame) -> DataFrame:
    """mfe with whether any variant touches its site or window."""
    touched = classes.select(F.col("mfe_id").alias("id")).distinct().withColumn("__touched", F.lit(True))
    return mfe.join(touched, "id", "left").withColumn("has_snp", F.coalesce("__touched", F.lit(False))).drop("__touched")


def of_class(classes: DataFrame, wanted: str, column: str = "class") -> DataFrame:
    """Rows of the classes named by letters: s, n, f, and d for any stem."""
    keep = F.lit(False)
    for letter in wanted:
        keep = keep | (F.col(column).rlike("^[0-9]+$") if letter == "d" else F.col(column) == letter)
    return classes.where(keep)


def species_summary(genes: DataFrame, points: DataFrame, seqlength: int = 100) -> DataFrame:
    """Genes, predictions of one length, and predictions a deviation below the mean on both axes, by species."""
    orfs = genes.groupBy("species").agg(F.count("*").alias("orfs"))
    own = points.where(F.col("seqlength") == seqlength)
    folds = own.groupBy("species").agg(F.count("*").alias("folds"))
    hits = beyond(own, 1).groupBy("species").agg(F.count_if("both").alias("significant"))
    return orfs.join(folds, "species", "left").join(hits, "species", "left").select("species", "orfs", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("folds", "significant")])


def beyond(points: DataFrame, deviations: int, keys: tuple[str, ...] = ("species", "seqlength", "mfe_method")) -> DataFrame:
    """points with low_mfe, low_z and both: below the mean of their keys by so many deviations. Moments are a small side joined back."""
    moments = points.groupBy(*keys).agg(F.avg("mfe").alias("__am"), F.stddev_pop("mfe").alias("__sm"), F.avg("zscore").alias("__az"), F.stddev_pop("zscore").alias("__sz"))
    out = points.join(moments, list(keys)).withColumn("low_mfe", F.col("mfe") < F.col("__am") - deviations * F.col("__sm")).withColumn("low_z", F.col("zscore") < F.col("__az") - deviations * F.col("__sz"))
    return out.withColumn("both", F.col("low_mfe") & F.col("low_z")).drop("__am", "__sm", "__az", "__sz")


def significant_counts(points: DataFrame) -> DataFrame:
    """Predictions beyond one and two deviations on both axes, all and knotted, by method."""
    two = beyond(beyond(points, 1).withColumnRenamed("both", "one"), 2)
    return two.groupBy("mfe_method").agg(
        F.count("*").alias("n"), F.count_if("one").alias("at_1"), F.count_if(F.col("one") & F.col("knotp")).alias("at_1_knotted"),
        F.count_if("both").alias("at_2"), F.count_if(F.col("both") & F.col("knotp")).alias("at_2_knotted"),
    )


def summary_pie(genes: DataFrame, points: DataFrame) -> DataFrame:
    """Genes without a prediction, with insignificant ones only, and with a significant one, by species of the gene."""
    seen = beyond(points, 1).groupBy("accession").agg(F.bool_or("both").alias("hit"))
    marked = genes.select("species", "accession").join(seen, "accession", "left")
    return marked.groupBy("species").agg(F.count_if(F.col("hit").isNull()).alias("no_match"), F.count_if(~F.col("hit")).alias("insignificant"), F.count_if("hit").alias("significant"))


def heptamer_count(points: DataFrame) -> DataFrame:
    """Sites (distinct places of genes) of each heptamer by species: places first, so that no row is multiplied."""
    return points.select("species", "slipsite", "accession", "start").distinct().groupBy("species", "slipsite").agg(F.count("*").alias("sites"))


def folds_per_site(mfe: DataFrame, genes: DataFrame) -> DataFrame:
    """Predictions of each site before the end of its frame, and of all such sites of the gene."""
    own = mfe.join(genes.select("accession", "orf_stop"), "accession").where("start < orf_stop")
    each = own.groupBy("accession", "start", "slipsite").agg(F.count("*").alias("folds"))
    return each.withColumn("total", F.sum("folds").over(Window.partitionBy("accession")))


def detail(mfe: DataFrame, genes: DataFrame) -> DataFrame:
    """Predictions with what is known of their gene; to be ordered by start, seqlength desc, method desc."""
    return mfe.join(genes.select("accession", "genename", "orf_start", "orf_stop"), "accession", "left")


def gene_bundle(genes: DataFrame, mfe: DataFrame, snps: DataFrame) -> DataFrame:
    """Each gene with its numbers of sites, predictions and variants; every side is counted before it is joined."""
    sites = mfe.select("accession", "start", "slipsite").distinct().groupBy("accession").agg(F.count("*").alias("sites"))
    folds, known = (df.groupBy("accession").agg(F.count("*").alias(name)) for df, name in ((mfe, "folds"), (snps, "variants")))
    out = genes.select("accession", "genename")
    for side in (sites, folds, known):
        out = out.join(side, "accession", "left")
    return out.select("accession", "genename", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sites", "folds", "variants")])


def at_coordinates(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Points whose energy in hundredths and z in tenths (whole numbers, rounded) are among the wanted (mfe100, z10)."""
    at = points.withColumn("mfe100", F.round(F.col("mfe") * 100).cast("long")).withColumn("z10", F.round(F.col("zscore") * 10).cast("long"))
    return at.join(wanted.select("mfe100", "z10").distinct(), ["mfe100", "z10"], "left_semi")


def known_signals(signals: DataFrame, mfe: DataFrame, tolerance: int = 3) -> DataFrame:
    """Known signals (accession, position) with the predicted starts within `tolerance` bases; those without any have null."""
    spans = signals.select("accession", F.col("position").alias("signal"), (F.col("position") - tolerance - 1).alias("lo"), (F.col("position") + tolerance + 1).alias("hi"))
    places = mfe.select("accession", F.col("start").alias("at"), F.col("start").alias("at_end")).distinct()
    met = binned_range_join(places, spans, "accession", 64).select("accession", F.col("signal").alias("position"), F.col("at").alias("start"))
    return signals.select("accession", "position").distinct().join(met, ["accession", "position"], "left")


def backfill(boot: DataFrame, mfe: DataFrame, columns: list[str]) -> DataFrame:
    """boot with nulls of the columns taken from the prediction it belongs to."""
    source = mfe.groupBy(F.col("id").alias("mfe_id")).agg(*[F.min(c).alias(f"__{c}") for c in columns])
    out = boot.join(source, "mfe_id", "left")
    return out.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in boot.columns])


def relink(boot: DataFrame, mfe: DataFrame) -> DataFrame:
    """Null models (id, accession, mfe_method, zscore, mfe_mean, mfe_sd, ...) that lost mfe_id, linked again by accession, method and
    the energy that z, deviation and mean give back, in whole tenths; the least id wins. verdict: linked, or deleted where nothing
    matches (then mfe_id is null); linked rows take species and seqlength from the prediction."""
    tenth = lambda c: F.round(c * 10).cast("long")
    known = mfe.groupBy("accession", "mfe_method", tenth(F.col("mfe")).alias("__e")).agg(F.min(F.struct("id", "species", "seqlength")).alias("__m"))
    lost = boot.drop("mfe_id", "species", "seqlength").withColumn("__e", tenth(F.col("mfe_sd") * F.col("zscore") + F.col("mfe_mean")))
    out = lost.join(known, ["accession", "mfe_method", "__e"], "left")
    verdict = F.when(F.col("__m").isNull(), "deleted").otherwise("linked")
    return out.select(*[c for c in lost.columns if c != "__e"], F.col("__m.id").alias("mfe_id"), "__m.species", "__m.seqlength", verdict.alias("verdict"))


def repair_knots(mfe: DataFrame, knotted_ids: DataFrame) -> DataFrame:
    """mfe with knotp set by the structures that have crossing pairs (one column, id)."""
    found = knotted_ids.select("id").distinct().withColumn("__knot", F.lit(True))
    return mfe.join(found, "id", "left").withColumn("knotp", F.coalesce("__knot", F.lit(False))).drop("__knot")


def without_repeats(df: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows that differ in some of the columns from the row before in their group."""
    w = Window.partitionBy(group).orderBy(*order)
    same = F.lit(True)
    for c in columns:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumn("__same", same & (F.row_number().over(w) > 1)).where("not __same").drop("__same")


def pick_one(df: DataFrame, key: str, seed: int | None = None) -> DataFrame:
    """One row: the least key, or the least digest of seed and key."""
    order = F.col(key) if seed is None else F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(order, key).limit(1)


def window_length_class(sequence: Column, wanted: Column) -> Column:
    n = F.length(sequence)
    return F.when(n.isNull() | (n == 0), "null").when(n < wanted, "shorter").when(n == wanted, "equal").otherwise("longer")


def fix_slipsites(mfe: DataFrame) -> DataFrame:
    """Sites in the alphabet of RNA."""
    return mfe.withColumn("slipsite", F.translate("slipsite", "Tt", "Uu"))


def gene_search(genes: DataFrame, exact: str | None = None, pattern: str | None = None) -> DataFrame:
    """Genes by their exact accession or name, or by a pattern over accession, name and comment."""
    if exact is not None:
        return genes.where((F.col("accession") == exact) | (F.col("genename") == exact))
    return genes.where(F.col("accession").rlike(pattern) | F.col("genename").rlike(pattern) | F.col("comment").rlike(pattern))


def criteria_select(df: DataFrame, columns: list[str], criteria: dict | None = None, order: list[str] | None = None) -> DataFrame:
    """Columns of the rows that meet all criteria: {column: value} or {column: (operator, value)}."""
    out = df
    for name, wanted in (criteria or {}).items():
        sign, value = wanted if isinstance(wanted, tuple) else ("=", wanted)
        c = F.col(name)
        out = out.where({"=": c == value, "<>": c != value, "<": c < value, ">": c > value, "<=": c <= value, ">=": c >= value}[sign])
    out = out.orderBy(*order) if order else out
    return out.select(*columns)


def dump_table(df: DataFrame, path: str, separator: str = ",", species: str | None = None) -> None:
    """Text with a header line, of all species or one."""
    own = df if species is None else df.where(F.col("species") == species)
    own.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def replace_slice(df: DataFrame, path: str, part: str) -> None:
    """Overwrite only the partitions of `part` that df holds; others are not touched, and a rerun writes the same."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def drop_accessions(tables: dict[str, DataFrame], accessions: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given accessions."""
    gone = accessions.select("accession").distinct()
    return {name: df.join(gone, "accession", "left_anti") for name, df in tables.items()}


def copy_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns under new names; all others are dropped."""
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()])


def cloud_cells(points: DataFrame) -> DataFrame:
    """(mfe10, z100, n, knotted, genes, share, quadrant): the cells of a cloud, energies in tenths and z-scores in hundredths (rounded),
    with the share of the fullest cell and the quadrant by the means of both axes (low or high energy, then z). The fullest
    cell and the means are one row that is joined to all cells; genes are counted, and listed by cloud_members."""
    at = points.select(F.round(F.col("mfe") * 10).cast("long").alias("mfe10"), F.round(F.col("zscore") * 100).cast("long").alias("z100"), "mfe", "zscore", "knotp", "accession")
    per_gene = at.groupBy("mfe10", "z100", "accession").agg(F.count("*").alias("n"), F.count_if("knotp").alias("knotted"), F.sum("mfe").alias("m"), F.sum("zscore").alias("z"))
    cells = per_gene.groupBy("mfe10", "z100").agg(F.sum("n").alias("n"), F.sum("knotted").alias("knotted"), F.count("accession").alias("genes"), F.sum("m").alias("m"), F.sum("z").alias("z"))
    whole = cells.agg(F.max("n").alias("most"), (F.sum("m") / F.sum("n") * 10).alias("mid_m"), (F.sum("z") / F.sum("n") * 100).alias("mid_z"))
    side = lambda c, mid: F.when(F.col(c) < F.col(mid), "low").otherwise("high")
    out = cells.join(F.broadcast(whole), F.lit(True))  # one row
    quadrant = F.concat_ws("/", side("mfe10", "mid_m"), side("z100", "mid_z"))
    return out.select("mfe10", "z100", "n", "knotted", "genes", F.round(F.col("n") / F.col("most"), 4).alias("share"), quadrant.alias("quadrant"))


def cloud_members(points: DataFrame) -> DataFrame:
    """(mfe10, z100, accession, n): the genes of each cell, a row each, so that a full cell isn't one row."""
    at = (F.round(F.col("mfe") * 10).cast("long").alias("mfe10"), F.round(F.col("zscore") * 100).cast("long").alias("z100"))
    return points.groupBy(*at, "accession").agg(F.count("*").alias("n"))


def lookup(df: DataFrame, table: DataFrame, on: dict[str, str], columns: dict[str, str], small: int = 100_000) -> DataFrame:
    """df with columns of a lookup table (on: column of df -> key of the table; columns: column of the table -> new name), null where
    the key is unknown. Of several rows of a key the least values count, so df's rows stay as many as they are. The table is
    broadcast where it has at most `small` keys."""
    keys = {c: f"__k{i}" for i, c in enumerate(on)}
    side = table.groupBy(*[F.col(k).alias(keys[c]) for c, k in on.items()]).agg(F.min(F.struct(*[F.col(c).alias(n) for c, n in columns.items()])).alias("__v"))
    if side.limit(small + 1).count() <= small:
        side = F.broadcast(side)
    match = F.lit(True)
    for c, k in keys.items():
        match = match & (F.col(c) == F.col(k))
    out = df.drop(*columns.values()).join(side, match, "left")
    return out.select(*[c for c in df.columns if c not in columns.values()], *[F.col(f"__v.{n}").alias(n) for n in columns.values()])


def union_methods(mfe: DataFrame, methods: list[str], columns: list[str]) -> DataFrame:
    """The distinct rows (columns) that any of the methods has: one filter and one aggregate instead of a union of scans."""
    return mfe.where(F.col("mfe_method").isin(methods)).select(*columns).distinct()


def related_rows(genes: DataFrame, mfe: DataFrame, snps: DataFrame, xrefs: DataFrame) -> DataFrame:
    """(accession, genename, kind, item, n): what belongs to each gene, a row for each site (start and heptamer, n predictions), variant
    (position) and cross-reference (kind:id); a gene without any has one row of kind none. Sides are counted before the join."""
    item = lambda df, kind, what: df.groupBy("accession", what.alias("item")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    rows = (
        item(mfe, "site", F.concat_ws(" ", "start", "slipsite")).unionByName(item(snps, "variant", F.col("position").cast("string"))).unionByName(item(xrefs, "xref", F.col("xref")))
    )
    out = genes.select("accession", "genename").join(rows, "accession", "left")
    return out.select("accession", "genename", F.coalesce("kind", F.lit("none")).alias("kind"), "item", F.coalesce("n", F.lit(0)).alias("n"))


def without_duplicates(mfe: DataFrame, boot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """mfe without the rows that repeat all keys of a row of lesser id (nulls are alike), and boot without the null models of these."""
    first = mfe.groupBy(*keys).agg(F.min("id").alias("id")).select("id")
    gone = mfe.join(first, "id", "left_anti").select("id").distinct()
    return mfe.join(gone, "id", "left_anti"), boot.join(gone.withColumnRenamed("id", "mfe_id"), "mfe_id", "left_anti")


def missing_randomizations(mfe: DataFrame, boot: DataFrame, randomizers: list[str], methods: list[str]) -> DataFrame:
    """(mfe_id, rand_method, mfe_method): the pairs of a randomizer and a method that each prediction has no null model (mfe_id,
    rand_method, mfe_method) of. The pairs that are there come as one set of few entries a prediction, so no grid is shuffled."""
    pair = lambda r, m: F.concat_ws("|", r, m)
    had = boot.groupBy("mfe_id").agg(F.collect_set(pair(F.col("rand_method"), F.col("mfe_method"))).alias("__had"))
    grid = F.array(*[F.struct(F.lit(r).alias("rand_method"), F.lit(m).alias("mfe_method")) for r in randomizers for m in methods])
    both = mfe.select(F.col("id").alias("mfe_id")).distinct().join(had, "mfe_id", "left").withColumn("__had", F.coalesce("__had", F.array().cast("array<string>")))
    lacking = F.filter(grid, lambda g: ~F.array_contains(F.col("__had"), pair(g["rand_method"], g["mfe_method"])))
    return both.select("mfe_id", F.explode(lacking).alias("g")).select("mfe_id", "g.*")


def species_by_method(points: DataFrame, methods: list[str]) -> DataFrame:
    """A row a species: for each method the folds, knotted ones and those a deviation below the mean on both axes (of that method),
    0 where there are none."""
    marked = beyond(points.where(F.col("mfe_method").isin(methods)), 1, ("species", "mfe_method"))
    own = lambda m, c=F.lit(True): F.count_if((F.col("mfe_method") == m) & c)
    figures = [x for m in methods for x in (own(m).alias(f"{m}_folds"), own(m, F.col("knotp")).alias(f"{m}_knotted"), own(m, F.col("both")).alias(f"{m}_significant"))]
    return marked.groupBy("species").agg(*figures)


def expression_stats(pairs: DataFrame, key: str = "gene") -> DataFrame:
    """Of each gene's pairs (healthy, cancer): mean, deviation and variance of exp(cancer - healthy), covariance and correlation of the
    two. Pairs with a null count nowhere; the correlation of a constant is null."""
    own = pairs.where(F.col("healthy").isNotNull() & F.col("cancer").isNotNull()).withColumn("__e", F.exp(F.col("cancer") - F.col("healthy")))
    flat = F.nullif(F.stddev_pop("healthy") * F.stddev_pop("cancer"), F.lit(0.0)).isNull()
    figures = {"mean": F.avg("__e"), "sd": F.stddev_pop("__e"), "variance": F.var_pop("__e"), "covariance": F.covar_pop("healthy", "cancer")}
    return own.groupBy(key).agg(F.count("*").alias("n"), *[F.round(c, 4).alias(n) for n, c in figures.items()], F.when(~flat, F.round(F.corr("healthy", "cancer"), 4)).alias("correlation"))


def long_extensions(sites: DataFrame, peptide: int = 30, bases: int = 150) -> DataFrame:
    """Sites whose frame goes on: a peptide (column minus_orf) of more than `peptide` amino acids, and more than `bases` bases to the
    -1 frame's stop (bp_mstop). Nulls don't qualify."""
    return sites.where((F.length("minus_orf") > peptide) & (F.col("bp_mstop") > bases))
