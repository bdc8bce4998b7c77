"""Bins, ranges and distances along a coordinate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sliding_bins(position: Column, size: int, step: int) -> Column:
    """Start of every bin of size, placed each step, whose closed interval holds the position: a point on a boundary is in both."""
    first = F.ceil((position - size) / F.lit(float(step))).cast("long")
    last = F.floor(position / F.lit(float(step))).cast("long")
    return F.transform(F.sequence(first, last), lambda k: k * step)


def tumbling_bin(position: Column, size: int) -> Column:
    return (F.floor(position / F.lit(float(size))) * size).cast("long")


#: Length of contig that an ordered window spans; what lies before it is carried over from one row a tile.
TILE = 1 << 20


def running_max(df: DataFrame, name: str, value: Column, by: list[str], order: list[str], strict: bool, tile: int = TILE) -> DataFrame:
    """Adds name: the largest value of the rows of the same by up to this one in order, or before it where strict; the first of
    order is a coordinate. No window spans more than a tile of it."""
    rows = df.withColumns({"_v": value, "_tile": F.floor(F.col(order[0]) / tile)})
    tiles = rows.groupBy(*by, "_tile").agg(F.max("_v").alias("_m"))
    before = Window.partitionBy(*by).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = tiles.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_tile").alias("_tile2"), F.max("_m").over(before).alias("_carry"))
    within = Window.partitionBy(*by, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    on = F.col("_tile") == F.col("_tile2")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = rows.withColumn("_w", F.max("_v").over(within)).join(carry, on).withColumn(name, F.greatest("_w", "_carry"))
    return out.drop("_v", "_w", "_tile", "_tile2", "_carry", *[f"_by{i}" for i in range(len(by))])


def merged_ranges(ranges: DataFrame, start: str, end: str, *by: str) -> DataFrame:
    """Unions of overlapping ranges of a contig (or other keys); ranges that only touch stay apart."""
    keys = list(by) or ["contig"]
    reach = running_max(ranges.select(*keys, start, end), "_reach", F.col(end), keys, [start, end], True)
    opened = F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), F.col(start))
    islands = running_max(reach, "_g", opened, keys, [start, end], False)
    return islands.groupBy(*keys, "_g").agg(F.min(start).alias("start_"), F.max(end).alias("end_")).drop("_g")


def gaps(merged: DataFrame, contigs: DataFrame) -> DataFrame:
    """What merged ranges (contig, start_, end_) leave of the contigs (contig, length_)."""
    rows = merged.select("contig", "start_", "end_").union(contigs.select("contig", F.col("length_"), F.col("length_")))
    rows = running_max(rows, "_reach", F.col("end_"), ["contig"], ["start_", "end_"], True)
    return rows.select("contig", F.coalesce("_reach", F.lit(0)).alias("gap_start"), F.col("start_").alias("gap_end")).where("gap_start < gap_end")


def blacklisted_bins(merged: DataFrame, contigs: DataFrame, size: int, halo: int) -> DataFrame:
    """Each gap in bins of about size, equalised, with the span to fetch: halo on both sides, within the gap."""
    g = gaps(merged, contigs).withColumn("_n", F.ceil((F.col("gap_end") - F.col("gap_start")) / F.lit(float(size))).cast("long"))
    g = g.withColumn("_w", F.col("gap_end") - F.col("gap_start")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = lambda i: F.col("gap_start") + F.floor(i * F.col("_w") / F.col("_n")).cast("long")
    b = g.select("contig", at(F.col("_i")).alias("bin_start"), at(F.col("_i") + 1).alias("bin_end"), "gap_start", "gap_end")
    return b.select("contig", "bin_start", "bin_end", F.greatest(F.col("bin_start") - halo, "gap_start").alias("fetch_start"), F.least(F.col("bin_end") + halo, "gap_end").alias("fetch_end"))


def consecutive_runs(df: DataFrame, position: str, *by: str) -> DataFrame:
    """Runs of consecutive integers."""
    d = running_max(df.select(*by, position).distinct(), "_last", F.col(position), list(by), [position], True)
    opened = F.when(F.col("_last").isNull() | (F.col(position) > F.col("_last") + 1), F.col(position))
    d = running_max(d, "run_start", opened, list(by), [position], False)
    return d.groupBy(*by, "run_start").agg(F.max(position).alias("run_end"))


def adjacent_distances(cuts: DataFrame, low: int, high: int, *by: str, position: str = "ds") -> DataFrame:
    """How often consecutive cuts lie a distance low < d < high apart."""
    w = Window.partitionBy(*by).orderBy(position)
    d = cuts.select(*by, position).distinct().withColumn("distance", F.col(position) - F.lag(position).over(w))
    return d.where((F.col("distance") > low) & (F.col("distance") < high)).groupBy("distance").agg(F.count("*").alias("n"))


def rolling_mean(df: DataFrame, value: str, order: str, reach: int, *by: str) -> DataFrame:
    """Centred mean over reach rows on both sides; rows without a whole frame are dropped."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn("_n", F.count("*").over(w)).withColumn("smooth", F.avg(value).over(w)).where(F.col("_n") == 2 * reach + 1).drop("_n")


def z_scores(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds z: the value's distance from its group's mean in population standard deviations; null where they are 0."""
    stats = df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return df.join(stats, on).withColumn("z", (F.col(value) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_mean", "_sd", *[f"_by{i}" for i in range(len(by))])


def nucleosome_votes(sites: DataFrame, low: int = 100, high: int = 200, size: int = 10) -> DataFrame:
    """Votes for the middle between two consecutive sites of a cell that lie low to high apart, by bins."""
    w = Window.partitionBy("sm", "contig").orderBy("ds")
    d = sites.select("sm", "contig", "ds").distinct().withColumn("_next", F.lead("ds").over(w)).where((F.col("_next") - F.col("ds")).between(low, high))
    return d.groupBy("contig", tumbling_bin((F.col("ds") + F.col("_next")) / 2, size).alias("bin_start")).agg(F.count("*").alias("votes"))
