"""Balanced shards by a minimax contiguous partition, in DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellweave.llm.frames import cut

#: Buckets of a shard within which rows are numbered; their totals are the only thing summed across buckets.
BUCKETS = 256


def _jump(starts: list[int], sizes: list[int], counts: list[int], at: int, capacity: int) -> int:
    """The position in bytes that a shard from position at reaches when filled up to capacity with whole groups.

    The order is a list of runs of equal groups; starts are the runs' first bytes."""
    end = at + capacity
    if end >= starts[-1]:
        return starts[-1]
    k = bisect_right(starts, end) - 1
    return starts[k] + (end - starts[k]) // sizes[k] * sizes[k]


def minimax_cuts(runs: list[tuple[int, int]], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity by which the ordered groups fit into shards, and the cuts in bytes.

    runs: (size, count) of groups in their order, positive sizes. The capacity is searched by bisection, each trial
    filling shard after shard greedily. The cuts then fill each shard up to its even share of what is left, never
    beyond the capacity; a shard that cannot leave enough for the others takes up to the capacity."""
    sizes, counts = [s for s, _ in runs], [c for _, c in runs]
    starts = [0]
    for s, c in runs:
        starts.append(starts[-1] + s * c)
    total = starts[-1]
    if not total:
        return 0, [0] * (shards - 1)

    def fits(capacity: int, at: int = 0, left: int = shards) -> bool:
        for _ in range(left):
            at = _jump(starts, sizes, counts, at, capacity)
            if at == total:
                return True
        return False

    low, high = max(max(sizes), -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        share = (total - at) / (left + 1)
        below = _jump(starts, sizes, counts, at, int(share))
        k = min(bisect_right(starts, below) - 1, len(sizes) - 1)
        above = min(below + sizes[k], total)
        near = above if below == at or above - at - share <= share - (below - at) else below
        options = [near, below, above, _jump(starts, sizes, counts, at, low)]
        at = next(x for x in options if x - at <= low and fits(low, x, left))
        cuts.append(at)
    return low, cuts


def shard_by_bytes(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row; law is 'bytes', grown_shard null.

    A row's size is its text's UTF-8 bytes plus 8. Rows of equal text are one atomic group, ordered by the group's
    bytes (largest first), then by the text's digest. Since the order is by size, it is a list of runs (size, number
    of groups), which is all that the driver gets: fewer than sqrt(2 * total bytes) entries, however many groups
    there are. The smallest feasible capacity is searched on it, and the cuts are made there. A cut inside a run is
    turned into a digest by counting the run's groups by ranges of the digest and numbering one range only.

    Null text counts as empty. Repeated rows each get a slot; null keys are kept. An empty table gives no rows. Other
    columns are ignored. A group larger than total / shards fills a shard of its own, and the rest is spread evenly."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(
        docs.select(
            F.col(key).alias("_key"), (F.octet_length(body) + 8).cast("long").alias("_size"), F.crc32(body.cast("binary")).alias("_crc"), F.md5(body.cast("binary")).alias("_md5")
        )
    )
    groups = cut(rows.groupBy("_md5").agg(F.sum("_size").alias("_bytes")))
    runs = sorted(((r._bytes, r.n) for r in groups.groupBy("_bytes").agg(F.count("*").alias("n")).collect()), reverse=True)
    _, cuts = minimax_cuts(runs, shards)

    # Each cut as (size, rank of the first group after it among those of that size).
    starts = [0]
    for s, c in runs:
        starts.append(starts[-1] + s * c)
    places = []
    for x in cuts:
        k = bisect_right(starts, x) - 1
        places.append((runs[k][0], (x - starts[k]) // runs[k][0]) if k < len(runs) else (0, 0))
    inner = sorted({s for s, r in places if r})
    first = {}  # the digest from which on groups of that size lie after the cut
    if inner:
        run = groups.where(F.col("_bytes").isin(inner)).select("_bytes", "_md5", F.substring("_md5", 1, 3).alias("_range"))
        by_range: dict[int, list] = {}
        for r in sorted(run.groupBy("_bytes", "_range").agg(F.count("*").alias("n")).collect()):
            by_range.setdefault(r._bytes, []).append((r._range, r.n))
        wanted = []
        for s, rank in {p for p in places if p[1]}:
            left = rank
            for name, n in by_range[s]:
                if left < n:
                    wanted.append((s, name, left + 1, rank))
                    break
                left -= n
        named = docs.sparkSession.createDataFrame(wanted, "_bytes long, _range string, _nth long, _rank long")
        numbered = run.join(F.broadcast(named.select("_bytes", "_range").distinct()), ["_bytes", "_range"]).withColumn(
            "_nth", F.row_number().over(Window.partitionBy("_bytes", "_range").orderBy("_md5")).cast("long")
        )
        first = {(r._bytes, r._rank): r._md5 for r in numbered.join(F.broadcast(named), ["_bytes", "_range", "_nth"]).collect()}
    after = [(s, first.get((s, r), "")) for s, r in places]

    def shard_of(size: Column, digest: Column) -> Column:
        table = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(d).alias("d")) for s, d in after]) if after else F.array().cast("array<struct<s:long,d:string>>")
        return F.size(F.filter(table, lambda c: (size < c["s"]) | ((size == c["s"]) & (digest >= c["d"])))).cast("int")

    placed = groups.select("_md5", shard_of(F.col("_bytes"), F.col("_md5")).alias("_shard"))
    rows = rows.join(placed, "_md5").withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
    rows = cut(rows.select("_key", "_size", "_crc", "_shard", "_bucket"))
    sums = rows.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    before = sums.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_shard", "_bucket", "_before")  # shards * buckets rows at most
    nth = F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy(F.col("_key").asc_nulls_first(), "_size", "_crc"))
    return (
        rows.withColumn("_nth", nth)
        .join(F.broadcast(before), ["_shard", "_bucket"])
        .select(
            F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
            F.col("_shard").alias("shard"), (F.col("_before") + F.col("_nth") - 1).cast(T.LongType()).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
