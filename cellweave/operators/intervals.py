"""Interval joins on a bin key, and nearest-feature joins by ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bounds of the width of the bins that make an equality key of an interval.
BIN = (128, 100_000)
#: Length of contig that an ordered window spans.
TILE = 20_000
#: Least width of the bins of a join, and features of a bin that move as one row.
LEAST, LIST = 64, 4096


def bin_size(features: DataFrame, start: str, end: str) -> int:
    """About the length that nine in ten features do not exceed: a power of two, by one aggregate over the features."""
    n = features.agg(F.percentile_approx(F.col(end) - F.col(start), 0.9, 200)).first()[0] or 0
    return min(BIN[1], max(BIN[0], 1 << max(0, int(n)).bit_length()))


def _bins(a: Column, b: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))


def partitions(spark: SparkSession) -> int:
    """Parts of a step that makes far more rows than it reads, which Spark would otherwise join by what is read."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_sharing(rows: DataFrame, *key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has, and those of shared keys; None where there are none."""
    shared = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)])
    if shared.isEmpty():
        return rows, None
    on = F.lit(True)
    for i, c in enumerate(key):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(shared, on, "left_anti"), rows.join(shared, on, "left_semi")


def _listed(features: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """(_contig, _fbin, _f): what a bin overlaps, as arrays of at most LIST rows ordered by start, which move to the bin's task as one row."""
    f = features.withColumnRenamed("contig", "_contig").withColumn("_fbin", _bins(F.col(start), F.col(end), size))
    row = F.struct(F.col(start).alias("_o"), *[c for c in features.columns if c != "contig"])
    order = Window.partitionBy("_contig", "_fbin").orderBy(start, end)
    chunks = f.withColumn("_n", F.floor((F.row_number().over(order) - 1) / F.lit(LIST))).groupBy("_contig", "_fbin", "_n").agg(F.sort_array(F.collect_list(row)).alias("_f"))
    return chunks.drop("_n").repartition(partitions(features.sparkSession), "_contig", "_fbin")


def _met(rows: DataFrame, features: DataFrame, start: str, end: str, size: int, order: list[str]) -> DataFrame:
    """Rows (with _bin) and each feature of their bin.

    Rows come in order, so that rows of one place follow one another with the same features: a file of the pairs, which are far more
    than the rows, holds such repeats in a fraction of their size. Only rows and lists move, never pairs."""
    listed = _listed(features, start, end, size)
    on = (F.col("contig") == F.col("_contig")) & (F.col("_bin") == F.col("_fbin"))
    dealt = rows.where(F.col("contig").isNotNull() & F.col("_bin").isNotNull()).repartition(partitions(rows.sparkSession), "contig", "_bin").sortWithinPartitions("contig", "_bin", *order)
    # Spark drops an order below a join, but not one below a column that is no function of the row
    dealt = dealt.withColumn("_part", F.spark_partition_id())
    met = dealt.join(listed, on).where("_part >= 0").select(*rows.columns, F.explode("_f").alias("_x"))
    return met.select(*rows.columns, *[F.col(f"_x.{c}").alias(c) for c in features.columns if c != "contig"])


def points_in(points: DataFrame, features: DataFrame, position: str = "ds", start: str = "f_start", end: str = "f_end", size: int | None = None, strand: bool = False) -> DataFrame:
    """Points and the features whose closed interval holds them, on the same contig (and strand)."""
    size = size or max(LEAST, bin_size(features, start, end) // 4)
    p = points.withColumn("_bin", F.floor(F.col(position) / size))
    on = F.col(position).between(F.col(start), F.col(end))
    if strand:
        on &= F.when(F.col("is_reverse"), "-").otherwise("+") == F.col("f_strand")
    return _met(p, features, start, end, size, [position]).where(on).drop("_bin")


def overlaps(left: DataFrame, right: DataFrame, ls: str = "start_", le: str = "end_", rs: str = "f_start", re: str = "f_end", size: int | None = None, half_open: bool = False) -> DataFrame:
    """Pairs of overlapping intervals, each once: a pair is taken in the bin where its overlap starts."""
    size = size or max(LEAST, bin_size(right, rs, re) // 4)
    a = left.withColumn("_bin", _bins(F.col(ls), F.col(le), size))
    first = F.greatest(ls, rs)
    meet = (F.greatest(ls, rs) < F.least(le, re)) if half_open else (F.greatest(ls, rs) <= F.least(le, re))
    return _met(a, right, rs, re, size, [ls, le]).where(meet & (F.col("_bin") == F.floor(first / size))).drop("_bin")


def covering_both_ends(left: DataFrame, features: DataFrame, ls: str = "start_", le: str = "end_", size: int | None = None) -> DataFrame:
    """Features that hold the first and the last position of an interval."""
    return overlaps(left, features, ls, le, size=size).where((F.col("f_start") <= F.col(ls)) & (F.col("f_end") >= F.col(le)))


def outside(rows: DataFrame, regions: DataFrame, contig: str, positions: tuple[str, ...], start: str, end: str, size: int | None = None) -> DataFrame:
    """Rows none of whose positions lies in a half-open region of their contig."""
    size = size or bin_size(regions, start, end)
    r = regions.select(F.col(contig).alias("_contig"), F.col(start).alias("_s"), F.col(end).alias("_e"), _bins(F.col(start), F.col(end), size).alias("_rbin"))
    for p in positions:
        on = (F.col(contig) == F.col("_contig")) & (F.floor(F.col(p) / size) == F.col("_rbin")) & (F.col(p) >= F.col("_s")) & (F.col(p) < F.col("_e"))
        rows = rows.join(r, on, "left_anti")
    return rows


def sums_before(events: DataFrame, points: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """(contig, _bin, _x, _at): for each of the points the sums of the events (contig, _bin, by, _x, sums) of its bin that lie before
    it, as one array of all groups that the bin has, in one order. A window spans a bin of a group."""
    events = events.groupBy("contig", "_bin", *by, "_x").agg(*[F.sum(c).alias(c) for c in sums])
    groups = events.select("contig", "_bin", *by).distinct()
    asked = points.select("contig", "_bin", "_x").distinct().join(groups, ["contig", "_bin"])
    rows = events.withColumn("_o", F.lit(1)).unionByName(asked.withColumn("_o", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("contig", "_bin", *by).orderBy("_x", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums}).where("_o = 0")
    return found.groupBy("contig", "_bin", "_x").agg(F.sort_array(F.collect_list(F.struct(*by, *sums))).alias("_at"))


def _cut_by_bin(regions: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """Half-open regions by bin, with the part (_lo, _hi) that lies in it."""
    r = regions.where(F.col(start) < F.col(end)).withColumn("_bin", _bins(F.col(start), F.col(end) - 1, size))
    low = F.col("_bin") * size
    return r.withColumns({"_lo": F.greatest(F.col(start).cast("long"), low), "_hi": F.least(F.col(end).cast("long"), low + size)})


def _at_both_ends(pieces: DataFrame, table: DataFrame) -> DataFrame:
    """Pieces (contig, _bin, _lo, _hi) with the arrays of the table at both ends (_a, _z), which name the same groups in one order."""
    a = table.select("contig", "_bin", F.col("_x").alias("_lo"), F.col("_at").alias("_a"))
    z = table.select("contig", "_bin", F.col("_x").alias("_hi"), F.col("_at").alias("_z"))
    return pieces.join(a, ["contig", "_bin", "_lo"]).join(z, ["contig", "_bin", "_hi"])


def _both_ends(pieces: DataFrame) -> DataFrame:
    return pieces.select("contig", "_bin", F.col("_lo").alias("_x")).union(pieces.select("contig", "_bin", F.col("_hi").alias("_x")))


def overlap_sums(rows: DataFrame, regions: DataFrame, by: list[str], keys: list[str], value: Column, ls: str = "start_", le: str = "end_", rs: str = "f_start", re: str = "f_end", size: int | None = None) -> DataFrame:
    """(keys, by, n, total): how many rows overlap (half-open) the regions of the same keys, and the sum of their values, by group.

    No pair is made: what overlaps a region begins before its end, less what ends at or before its start. Both are sums over the
    ordered ends of a bin, so the work grows with rows and with regions times the groups of their bins, not with their product.
    A total is a difference of sums over one bin; counts are exact."""
    size = size or bin_size(regions, rs, re)
    r = rows.where((F.col(ls) < F.col(le)) & F.col("contig").isNotNull()).select("contig", *by, F.col(ls).cast("long").alias("_s"), F.col(le).cast("long").alias("_e"), value.alias("_v"))
    r = r.withColumn("_bin", _bins(F.col("_s"), F.col("_e") - 1, size))
    low, none, nothing = F.col("_bin") * size, F.lit(0).cast("long"), F.lit(None).cast(r.schema["_v"].dataType)
    one = F.lit(1).cast("long")

    def event(at: Column, *what: Column) -> Column:
        return F.struct(at.alias("_x"), *[c.alias(k) for k, c in zip(("_sn", "_sv", "_en", "_ev"), what, strict=True)])

    begins = event(F.greatest(F.col("_s"), low - 1), one, F.col("_v"), none, nothing)
    ends = event(F.col("_e") - 1, none, nothing, one, F.col("_v"))
    events = r.select("contig", "_bin", *by, F.explode(F.when(F.col("_e") < low + size, F.array(begins, ends)).otherwise(F.array(begins))).alias("_ev_")).select("contig", "_bin", *by, "_ev_.*")
    pieces = _cut_by_bin(regions.select(*dict.fromkeys(["contig", rs, re, *keys])), rs, re, size)
    met = _at_both_ends(pieces, sums_before(events, _both_ends(pieces), by, ["_sn", "_sv", "_en", "_ev"]))
    first = F.floor(F.col(rs) / size) == F.col("_bin")

    def less(z: Column, a: Column) -> Column:
        return F.struct(*[z[c].alias(c) for c in by], (z["_sn"] - F.when(first, a["_en"]).otherwise(a["_sn"])).alias("_n"), (z["_sv"] - F.when(first, a["_ev"]).otherwise(a["_sv"])).alias("_t"))

    each = met.select(*keys, F.explode(F.filter(F.zip_with("_z", "_a", less), lambda g: g["_n"] > 0)).alias("_g")).select(*keys, *[F.col(f"_g.{c}").alias(c) for c in by], "_g._n", "_g._t")
    return each.groupBy(*keys, *by).agg(F.sum("_n").alias("n"), F.sum("_t").alias("total"))


def site_counts(rows: DataFrame, regions: DataFrame, by: list[str], keys: list[str], site: str = "ds", size: int | None = None) -> DataFrame:
    """(keys, by, n): how many rows (start_, end_) overlap a region (half-open) and have their site in it, both ends included.

    A site within its row is in the region where the bases beside it are, so it is counted as an interval of its own, without
    pairs; rows whose site lies outside of them are joined."""
    size = size or bin_size(regions, "f_start", "f_end")
    at, start, end = F.col(site), F.col("start_"), F.col("end_")
    rows = rows.where((start < end) & at.isNotNull())
    own = rows.where(at.between(start, end)).withColumns({"_from": F.when(at == start, at).otherwise(at - 1), "_until": F.when(at == end, at).otherwise(at + 1)})
    counted = overlap_sums(own, regions, by, keys, F.lit(1), "_from", "_until", size=size).drop("total")
    apart = overlaps(rows.where(~at.between(start, end)).select("contig", "start_", "end_", site, *by), regions, size=size, half_open=True)
    apart = apart.where(at.between(F.col("f_start"), F.col("f_end"))).groupBy(*keys, *by).agg(F.count("*").alias("n"))
    return counted.unionByName(apart).groupBy(*keys, *by).agg(F.sum("n").alias("n"))


def covered_bases(blocks: DataFrame, regions: DataFrame, by: list[str], keys: list[str], bs: str = "b_start", be: str = "b_end", rs: str = "f_start", re: str = "f_end", size: int | None = None) -> DataFrame:
    """(keys, by, n): bases of half-open blocks in closed regions, without a row a base: what blocks cover before a place is the
    place times the blocks open there, less their starts and ends, summed in order over a bin."""
    size = size or bin_size(regions, rs, re)
    b = _cut_by_bin(blocks.where("contig is not null").select("contig", *by, bs, be), bs, be, size)
    ends = F.array(F.struct(F.col("_lo").alias("_x"), F.lit(1).cast("long").alias("_d"), F.col("_lo").alias("_q")), F.struct(F.col("_hi").alias("_x"), F.lit(-1).cast("long").alias("_d"), (-F.col("_hi")).alias("_q")))
    events = b.select("contig", "_bin", *by, F.explode(ends).alias("_ev_")).select("contig", "_bin", *by, "_ev_.*")
    closed = regions.select(*dict.fromkeys(["contig", rs, re, *keys])).withColumn("_after", F.col(re) + 1)
    pieces = _cut_by_bin(closed, rs, "_after", size)
    met = _at_both_ends(pieces, sums_before(events, _both_ends(pieces), by, ["_d", "_q"]))

    def less(z: Column, a: Column) -> Column:
        return F.struct(*[z[c].alias(c) for c in by], (F.col("_hi") * z["_d"] - z["_q"] - F.col("_lo") * a["_d"] + a["_q"]).alias("_n"))

    each = met.select(*keys, F.explode(F.filter(F.zip_with("_z", "_a", less), lambda g: g["_n"] > 0)).alias("_g")).select(*keys, *[F.col(f"_g.{c}").alias(c) for c in by], "_g._n")
    return each.groupBy(*keys, *by).agg(F.sum("_n").alias("n"))


def nearest(points: DataFrame, features: DataFrame, position: str = "ds", key: str = "read_index") -> DataFrame:
    """(key, left_end, right_start, left_distance, right_distance): the nearest feature end at or before each point and the
    nearest start at or after it. An as-of join: both sides in one order, the last and the first value that is not null.

    Points of one place have the same neighbours, which are sought once a place, so a window holds a few rows a base of its tile at most."""
    none = "cast(null as long)"
    pts = points.selectExpr("contig as _c", f"cast({position} as long) as _p").distinct().selectExpr("*", "true as _k", f"{none} as _e", f"{none} as _s", "1 as _o")
    ends = features.selectExpr("contig as _c", "cast(f_end as long) as _p").distinct().selectExpr("*", "cast(null as boolean) as _k", "_p + 0 as _e", f"{none} as _s", "0 as _o")
    starts = features.selectExpr("contig as _c", "cast(f_start as long) as _p").distinct().selectExpr("*", "cast(null as boolean) as _k", f"{none} as _e", "_p + 0 as _s", "2 as _o")
    rows = pts.unionByName(ends).unionByName(starts)
    # Windows span a tile of a contig; what lies in other tiles is carried over from one row a tile.
    rows = rows.withColumn("_t", F.floor(F.col("_p") / TILE))
    tiles = rows.groupBy("_c", "_t").agg(F.max("_e").alias("_te"), F.min("_s").alias("_ts"))
    order = Window.partitionBy("_c").orderBy("_t")
    carry = tiles.select(
        F.col("_c").alias("_tc"), F.col("_t").alias("_tt"), F.max("_te").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_ce"),
        F.min("_ts").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_cs"),
    )
    before = Window.partitionBy("_c", "_t").orderBy("_p", "_o").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_c", "_t").orderBy(F.desc("_p"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("left_end", F.last("_e", True).over(before)).withColumn("right_start", F.last("_s", True).over(after)).where("_k is not null")
    out = out.join(carry, (F.col("_c") == F.col("_tc")) & (F.col("_t") == F.col("_tt")))
    places = out.select("_c", "_p", F.coalesce("left_end", "_ce").alias("left_end"), F.coalesce("right_start", "_cs").alias("right_start"))
    asked = points.selectExpr("contig as _pc", f"cast({position} as long) as _pp", f"cast({key} as long) as {key}").where(F.col(key).isNotNull())
    out = asked.join(places, (F.col("_pc") == F.col("_c")) & (F.col("_pp") == F.col("_p")))
    return out.select(key, "left_end", "right_start", (F.col("_pp") - F.col("left_end")).alias("left_distance"), (F.col("right_start") - F.col("_pp")).alias("right_distance"))


def band_pairs(cuts: DataFrame, reach: int) -> DataFrame:
    """Forward cuts and the reverse cuts of the same cell and contig that lie 0 < distance < reach further on."""
    f = cuts.where("not is_reverse").select("sm", "contig", F.col("ds").alias("fwd"), F.explode(F.array(F.floor(F.col("ds") / reach), F.floor(F.col("ds") / reach) + 1)).alias("_b"))
    r = cuts.where("is_reverse").select(F.col("sm").alias("_sm"), F.col("contig").alias("_c"), F.col("ds").alias("rev"), F.floor(F.col("ds") / reach).alias("_rb"))
    on = (F.col("sm") == F.col("_sm")) & (F.col("contig") == F.col("_c")) & (F.col("_b") == F.col("_rb"))
    d = F.col("rev") - F.col("fwd")
    return f.join(r, on).where((d > 0) & (d < reach)).select("sm", "contig", "fwd", "rev")
