"""Cuts and fragments by bins, cells and single places of the genome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators import intervals
from cellweave.operators.windows import tumbling_bin


def cut_position() -> Column:
    """The site of a read where it has one, else the edge that was sequenced first."""
    return F.coalesce("ds", F.when(F.col("is_reverse"), F.col("end_")).otherwise(F.col("start_")))


def cuts_by_bin(reads: DataFrame, size: int, low: int | None = None, high: int | None = None, keep: Column | None = None) -> DataFrame:
    """(contig, bin, sample, n): first mates that are neither failed nor duplicates (or those that keep holds for), by bin of
    their cut; low and high are both within the region. Reads without a cell are of No_Sample."""
    default = F.col("is_read1") & ~F.col("duplicate") & ~F.col("qcfail")
    rows = reads.where(default if keep is None else keep).withColumn("_cut", cut_position())
    if low is not None:
        rows = rows.where(F.col("_cut") >= low)
    if high is not None:
        rows = rows.where(F.col("_cut") <= high)
    return rows.groupBy("contig", tumbling_bin(F.col("_cut"), size).alias("bin"), F.coalesce("sm", F.lit("No_Sample")).alias("sample")).agg(F.count("*").alias("n"))


def cuts_by_region(reads: DataFrame, regions: DataFrame, size: int, ligation: str | None = None) -> DataFrame:
    """(group, contig, bin, alias, sample, n): cuts of groups of files (group) in regions (contig, low, high, alias; null: open),
    by bin, or by alias where a region has one. Only reads with a site count; ligation keeps those of one motif (lh)."""
    rows = reads.where(F.col("is_read1") & ~F.col("duplicate") & ~F.col("qcfail") & F.col("ds").isNotNull())
    if ligation is not None:
        rows = rows.where(F.col("lh") == ligation)
    r = regions.select(F.col("contig").alias("_c"), "low", "high", "alias")
    inside = (F.col("low").isNull() | (F.col("ds") >= F.col("low"))) & (F.col("high").isNull() | (F.col("ds") <= F.col("high")))
    rows = rows.join(r, (F.col("contig") == F.col("_c")) & inside)
    key = F.when(F.col("alias").isNull(), tumbling_bin(F.col("ds"), size))
    return rows.groupBy("group", "contig", key.alias("bin"), "alias", F.coalesce("sm", F.lit("No_Sample")).alias("sample")).agg(F.count("*").alias("n"))


def fragments_by_bin(reads: DataFrame, contigs: DataFrame, size: int, keep: Column, *tags: str, spans: DataFrame | None = None) -> DataFrame:
    """(tags, contig, bin_start, bin_end, sample, n) of first mates that keep holds for; the last bin ends with its contig. With
    spans (contig, primary, offset) sites of alternative contigs are counted where they lie on the primary one."""
    site = F.coalesce("ds", "start_", "end_")
    rows = reads.where(keep).select(*tags, "contig", site.alias("_site"), F.coalesce("sm", F.lit("bulk")).alias("sample"))
    if spans is not None:
        rows = lifted(rows, spans, "_site")
    start = tumbling_bin(F.col("_site"), size)
    rows = rows.join(contigs.select(F.col("contig").alias("_c"), "length_"), F.col("contig") == F.col("_c"))
    return rows.groupBy(*tags, "contig", start.alias("bin_start"), F.least(start + size, "length_").alias("bin_end"), "sample").agg(F.count("*").alias("n"))


def lifted(rows: DataFrame, spans: DataFrame, position: str) -> DataFrame:
    """Rows whose contig is an alternative one, moved to its primary contig (spans: contig, primary, offset)."""
    s = spans.select(F.col("contig").alias("_alt"), "primary", "offset")
    out = rows.join(s, F.col("contig") == F.col("_alt"), "left")
    return out.withColumns({"contig": F.coalesce("primary", "contig"), position: F.col(position) + F.coalesce("offset", F.lit(0))}).drop("_alt", "primary", "offset")


def whole_bins(contigs: DataFrame, size: int) -> DataFrame:
    """(contig, bin_start, bin_end) of all whole bins; a contig's last part of one is left out."""
    n = F.floor(F.col("length_") / size)
    rows = contigs.where(n > 0).select("contig", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("_k"))
    return rows.select("contig", (F.col("_k") * size).alias("bin_start"), ((F.col("_k") + 1) * size).alias("bin_end"))


def fixed_matrix(reads: DataFrame, contigs: DataFrame, size: int, min_mapq: int = 1) -> DataFrame:
    """(patient, sm, contig, bin_start, bin_end, n) for every cell and whole bin, 0 where a cell has no cut there.

    Rows are as many as the matrix has cells, which is what is asked for; the counts are made before the grid is laid."""
    used = reads.where(~F.col("is_read2") & ~F.col("qcfail") & ~F.col("duplicate") & F.col("ds").isNotNull() & (F.col("mapq") >= min_mapq))
    counts = used.groupBy("patient", "sm", "contig", tumbling_bin(F.col("ds"), size).alias("bin_start")).agg(F.count("*").alias("n"))
    cells = reads.select("patient", "sm").distinct()
    lists = cells.groupBy("patient").agg(F.collect_list("sm").alias("_cells"))
    grid = whole_bins(contigs, size).join(lists).select("patient", F.explode("_cells").alias("sm"), "contig", "bin_start", "bin_end")
    return grid.join(counts, ["patient", "sm", "contig", "bin_start"], "left").select("patient", "sm", "contig", "bin_start", "bin_end", F.coalesce("n", F.lit(0)).alias("n"))


def unique_firsts(reads: DataFrame, prefix: Column | None = None) -> DataFrame:
    """First mates of each cell that are neither failed nor duplicates, with a prefix for the file they come from."""
    by = ([prefix.alias("prefix")] if prefix is not None else []) + [F.col("sm")]
    return reads.where(F.col("is_read1") & ~F.col("qcfail") & ~F.col("duplicate")).groupBy(*by).agg(F.count("*").alias("n"))


def cut_arrays(reads: DataFrame, above: int = 50) -> DataFrame:
    """(sm, contig, cuts, total): the sorted sites of each cell and contig of first mates mapped better than above, and how many
    the cell has on all contigs. A cell's sites on a contig are bounded by the genome's."""
    rows = reads.where(F.col("is_read1") & ~F.col("qcfail") & ~F.col("duplicate") & (F.col("mapq") > above))
    lists = rows.groupBy("sm", "contig").agg(F.sort_array(F.collect_list("ds")).alias("cuts"))
    totals = lists.groupBy(F.col("sm").alias("_sm")).agg(F.sum(F.size("cuts")).alias("total"))
    return lists.join(totals, F.col("sm") == F.col("_sm")).drop("_sm")


def methylation_and_abundance(reads: DataFrame, size: int, min_mapq: int, contexts: str = "xhz") -> DataFrame:
    """(kind, context, allele, contig, bin, sm, n) of unduplicated, uniquely mapped reads with a site: met and unmet calls by
    context, fragments, and the reads behind them (af). calls maps a symbol to its number; a motif other than CATG does not
    count."""
    rows = reads.where(~F.col("duplicate") & (F.col("mp").isNull() | (F.col("mp") == "unique")) & (F.col("mapq") >= min_mapq) & F.col("ds").isNotNull() & F.coalesce(F.col("rz") == "CATG", F.lit(True)))
    rows = rows.withColumns({"allele": F.coalesce("da", F.lit("unk")), "bin": F.floor(F.col("ds") / size)})
    one = lambda kind, context, n: F.struct(F.lit(kind).alias("kind"), F.lit(context).cast("string").alias("context"), n.cast("long").alias("n"))
    entries = [one("fragments", None, F.lit(1)), one("reads", None, F.col("af"))]
    for c in contexts:
        entries += [one("met", c, F.try_element_at("calls", F.lit(c.upper()))), one("unmet", c, F.try_element_at("calls", F.lit(c)))]
    each = rows.select("allele", "contig", "bin", "sm", F.explode(F.array(*entries)).alias("_e")).select("*", "_e.*").where("n is not null")
    return each.groupBy("kind", "context", "allele", "contig", "bin", "sm").agg(F.sum("n").alias("n"))


def by_cell_index(reads: DataFrame, regions: DataFrame, cells: int = 384) -> DataFrame:
    """(f_name, cell, n) for cells numbered 1 to cells (bi): reads that overlap a region and have their site in it, failed and
    duplicate reads left out."""
    rows = reads.where(~F.col("qcfail") & ~F.col("duplicate") & F.col("bi").between(1, cells))
    return intervals.site_counts(rows.withColumnRenamed("bi", "cell"), regions, ["cell"], ["f_name"])


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, bin_start, n, share_above) of all bins of equal width from low; what is beyond high is in the last, what is under low
    in none. share_above is the share of values in later bins. Nulls do not count."""
    width = (high - low) / bins
    spark = values.sparkSession
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    n = values.where(F.col(column) >= low).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    out = spark.range(bins).select(F.col("id").alias("bin")).join(n, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n"))
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(1))  # as many rows as bins
    later = Window.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    return out.withColumn("share_above", F.coalesce(F.sum("n").over(later), F.lit(0)) / F.nullif(F.sum("n").over(every), F.lit(0)))
