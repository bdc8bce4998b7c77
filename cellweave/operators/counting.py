"""The count table: weights, keys, bins and regions over filtered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators import intervals, windows


def weight(divide_fragments: bool = True, divide_multimapping: bool = False, paired: Column | None = None) -> Column:
    """One, or a half for a mapped pair's mate; over the number of alignments where asked (XA's entries and its trailing one, else NH)."""
    w = F.when(paired if paired is not None else F.lit(True), 0.5).otherwise(1.0) if divide_fragments else F.lit(1.0)
    if divide_multimapping:
        w = w / F.when(F.col("xa").isNotNull(), F.size(F.split("xa", ";"))).when(F.col("nh").isNotNull(), F.col("nh")).otherwise(1)
    return w


def tag(c: str) -> Column:
    """A tag's value as text; what is absent reads 'None'."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def joined_features(reads: DataFrame, sample: list[str], features: list[str], value: Column) -> DataFrame:
    """One composite key of all features."""
    return reads.groupBy(*sample, *[tag(f).alias(f"f_{f}") for f in features]).agg(F.sum(value).alias("n"))


def separate_features(reads: DataFrame, sample: list[str], features: list[str], value: Column) -> DataFrame:
    """One row for each feature's value, in one namespace."""
    keyed = reads.select(*sample, value.alias("_v"), F.explode(F.array(*[tag(f) for f in features])).alias("feature"))
    return keyed.groupBy(*sample, "feature").agg(F.sum("_v").alias("n"))


def split_features(reads: DataFrame, sample: list[str], features: list[str], by: str, value: Column) -> DataFrame:
    """Every combination of the parts of the features; an empty part reads 'None'."""
    out = reads.select(*sample, *features, value.alias("_v"))
    for f in features:
        out = out.withColumn(f"f_{f}", F.explode(F.transform(F.split(tag(f), f"[{by}]"), lambda x: F.when(x == "", "None").otherwise(x))))
    return out.groupBy(*sample, *[f"f_{f}" for f in features]).agg(F.sum("_v").alias("n"))


def by_value(reads: DataFrame, sample: list[str], column: str) -> DataFrame:
    """Sums of a tag read as a number; what is none counts as 0."""
    return reads.groupBy(*sample).agg(F.sum(F.coalesce(F.expr(f"try_cast({column} as double)"), F.lit(0.0))).alias("n"))


def binned(reads: DataFrame, contigs: DataFrame, sample: list[str], size: int, step: int, value: Column, over_bounds: bool = False) -> DataFrame:
    """Counts in sliding bins (closed at both ends); bins beyond the contig are dropped unless asked for."""
    rows = reads.select(*sample, "contig", value.alias("_v"), F.explode(windows.sliding_bins(F.col("ds"), size, step)).alias("bin_start"))
    if not over_bounds:
        lengths = contigs.select(F.col("contig").alias("_c"), "length_")
        rows = rows.join(lengths, F.col("contig") == F.col("_c")).where((F.col("bin_start") >= 0) & (F.col("bin_start") + size <= F.col("length_")))
    return rows.groupBy(*sample, "contig", "bin_start", (F.col("bin_start") + size).alias("bin_end")).agg(F.sum("_v").alias("n"))


def by_region(reads: DataFrame, regions: DataFrame, sample: list[str], value: Column) -> DataFrame:
    """Each read once for each region that it overlaps (half-open)."""
    keys = ["contig", "f_start", "f_end", "f_name"]
    return intervals.overlap_sums(reads, regions, sample, keys, value).select(*sample, *keys, F.col("total").alias("n"))


def region_sites(reads: DataFrame, regions: DataFrame, sample: list[str]) -> DataFrame:
    """Reads that overlap a region and whose site lies in it, both ends included."""
    return intervals.site_counts(reads, regions, sample, ["f_name"]).select(*sample, "f_name", "n")


def bulk(table: DataFrame, sample: list[str]) -> DataFrame:
    """Sums over all samples."""
    keys = [c for c in table.columns if c not in (*sample, "n")]
    return table.groupBy(*keys).agg(F.sum("n").alias("n"))


def matrix(table: DataFrame, rows: list[str], column: str, names: list[str] | None = None) -> DataFrame:
    """The table as a matrix, one column for each value of column; give names to spare the pass that finds them."""
    return table.groupBy(*rows).pivot(column, names).agg(F.sum("n")).orderBy(*rows)


def overseq(reads: DataFrame, size: int) -> DataFrame:
    """How many molecules of a bin and sample have so many copies."""
    m = reads.groupBy("sm", windows.tumbling_bin(F.col("ds"), size).alias("bin_start"), "contig", "ds", "is_reverse", "rx").agg(F.count("*").alias("copies"))
    return m.groupBy("contig", "bin_start", "sm", "copies").agg(F.count("*").alias("molecules"))
