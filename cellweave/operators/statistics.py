"""Library statistics, one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _n(c: Column) -> Column:
    return F.sum(c.cast("long"))


def read_counts(reads: DataFrame) -> DataFrame:
    mapped = ~F.col("unmapped")
    return reads.groupBy("is_read1").agg(
        F.count("*").alias("total"), _n(mapped).alias("mapped"), _n(F.col("unmapped")).alias("unmapped"), _n(mapped & F.col("ds").isNotNull() & ~F.col("qcfail")).alias("assigned"),
        _n(mapped & ~F.col("qcfail") & ~F.col("duplicate")).alias("deduplicated"),
    )


def cell_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sm").agg(F.count("*").alias("reads"), _n(~F.col("duplicate")).alias("umis"))


def histogram(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n"))


def safe_read(min_mapq: int = 60, max_edits: int = 2) -> Column:
    """Properly paired first mates, mapped with certainty, without indels or clips; a missing edit count passes."""
    edits = F.col("nm").isNull() | (F.col("nm") <= max_edits)
    return ~F.col("unmapped") & F.col("proper") & ~F.col("qcfail") & F.col("is_read1") & (F.col("mapq") >= min_mapq) & edits & ~F.col("cigar").rlike("[ISD]")


def cascade(reads: DataFrame, *by: str) -> DataFrame:
    """Unmapped, failed, duplicate, safe and other reads: each read in the first class that fits."""
    safe = safe_read()
    kind = F.when(F.col("unmapped"), "unmapped").when(F.col("qcfail"), "qcfail").when(F.col("duplicate"), "duplicate").when(safe, "safe").otherwise("pass")
    return reads.groupBy(*by, kind.alias("kind")).agg(F.count("*").alias("n"))


def plate(reads: DataFrame, cells: Column, columns: int) -> DataFrame:
    """Counts by place on a plate whose cells are numbered from 1 along its rows."""
    i = cells - 1
    return reads.groupBy("ly", F.floor(i / columns).cast("int").alias("row"), (i % columns).cast("int").alias("col")).agg(
        F.count("*").alias("total"), _n(F.col("qcfail")).alias("qcfail"), _n(~F.col("qcfail") & ~F.col("duplicate")).alias("molecules")
    )


def start_ratio(reads: DataFrame, motif: Column) -> DataFrame:
    """Share of first, unduplicated reads of each cell that start with TA."""
    return reads.where("is_read1 and not duplicate").groupBy("sm").agg(F.avg((motif == "TA").cast("double")).alias("ta"), F.count("*").alias("n"))


def conversions(bases: DataFrame) -> DataFrame:
    return bases.where("mapq >= 30").groupBy("ref", "base", "is_read1", "is_reverse").agg(F.count("*").alias("n"))


def lorenz(df: DataFrame, by: str, bins: int = 100) -> DataFrame:
    """(rank, share): cumulative share of the counts of by, ascending. Counts of equal size are one step, so that no sort of all
    values meets in one task: the histogram of counts does."""
    steps = df.groupBy(by).agg(F.count("*").alias("v")).groupBy("v").agg(F.count("*").alias("m"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    everything = steps.agg(F.sum(F.col("v") * F.col("m")).alias("_t"), F.sum("m").alias("_k"))
    out = steps.withColumn("_a", F.sum("m").over(w)).withColumn("_s", F.sum(F.col("v") * F.col("m")).over(w))
    return out.join(F.broadcast(everything)).select("v", (F.col("_a") / F.col("_k")).alias("rank"), (F.col("_s") / F.col("_t")).alias("share"))


def oversequencing(molecules: DataFrame) -> DataFrame:
    """How many molecules have so many fragments."""
    return molecules.groupBy("fragments").agg(F.count("*").alias("n"))


def mapping_rate(reads: DataFrame, *by: str) -> DataFrame:
    return reads.groupBy(*by).agg(F.avg((~F.col("unmapped")).cast("double")).alias("rate"))


def moments(df: DataFrame, value: str, n: str, *by: str) -> DataFrame:
    """Mean and population standard deviation of a counter."""
    w, x = F.col(n).cast("double"), F.col(value).cast("double")
    g = df.groupBy(*by).agg(F.sum(w).alias("_w"), F.sum(w * x).alias("_x"), F.sum(w * x * x).alias("_xx"))
    mean = F.col("_x") / F.col("_w")
    return g.select(*by, mean.alias("mean"), F.sqrt(F.greatest(F.col("_xx") / F.col("_w") - mean * mean, F.lit(0.0))).alias("deviation"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two columns, in nats."""
    n = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pa = n.groupBy(a).agg(F.sum("n").alias("_a"))
    pb = n.groupBy(b).agg(F.sum("n").alias("_b"))
    t = n.agg(F.sum("n").alias("_t"))
    j = n.join(pa, a).join(pb, b).join(F.broadcast(t))
    return j.agg(F.sum(F.col("n") / F.col("_t") * F.log(F.col("n") * F.col("_t") / (F.col("_a") * F.col("_b")))).alias("mi"))


#: Single counts that one row stands for while they are hashed.
DRAWS = 10_000


def downsampled(counts: DataFrame, cell: str, item: str, total: int, seed: int = 1) -> DataFrame:
    """At most total of each cell's counts (cell, item, n), picked by a seeded hash of every single count.

    Counts are hashed DRAWS at a time, in as many tasks as a shuffle has, and each lot keeps its total lowest hashes; the lowest of
    a cell are among them."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lots = counts.where("n > 0").select(cell, item, F.col("n").cast("long").alias("_n"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"), F.lit(DRAWS).cast("long"))).alias("_k"))
    lots = lots.repartition(parts, cell, item, "_k")
    name = lambda k: F.md5(F.concat_ws(":", F.col(cell).cast("string"), F.col(item).cast("string"), k.cast("string"), F.lit(str(seed))))
    hashes = F.transform(F.sequence(F.col("_k"), F.least(F.col("_k") + DRAWS - 1, F.col("_n"))), name)
    one = lots.select(cell, item, F.explode(F.slice(F.array_sort(hashes), 1, total)).alias("_h"))
    picked = one.withColumn("_r", F.row_number().over(Window.partitionBy(cell).orderBy("_h"))).where(F.col("_r") <= total)
    return picked.groupBy(cell, item).agg(F.count("*").alias("n"))


# The tags by which a demultiplexer marks trimmed reads.
TRIM_TAGS = ("a1", "eB", "A2", "EB")


def by_value(reads: DataFrame, c: str, *by: str, missing: str | None = None) -> DataFrame:
    """Reads by the value of a tag (reasons of rejection, data types, alleles); missing names the nulls, else they stay."""
    value = F.col(c) if missing is None else F.coalesce(F.col(c), F.lit(missing))
    return reads.groupBy(*by, value.alias(c)).agg(F.count("*").alias("n"))


def trimmed(reads: DataFrame) -> DataFrame:
    """Reads that carry any of the trimming tags, each mate for itself, and all reads."""
    has = F.coalesce(F.arrays_overlap(F.map_keys("tags"), F.array(*[F.lit(t) for t in TRIM_TAGS])), F.lit(False))
    return reads.agg(F.coalesce(_n(has), F.lit(0)).alias("trimmed"), F.count("*").alias("reads"))
