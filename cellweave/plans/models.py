"""Queries of pile-ups, models over counts, molecule bounds and smoothing, with the SQL of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import sequence as S
from cellweave.operators import bases as B
from cellweave.operators import models as M
from cellweave.operators import calls, molecules, pileup
from cellweave.plans.variation import _WALK, q
from cellweave.plans.views import view


def _places(spark, d):
    return view(spark, d, "features").select("contig", F.col("f_start").alias("pos"))


@q(
    "mate_pileup",
    f"""WITH {_WALK}, h AS (SELECT DISTINCT b.contig, pos, query_name FROM bases b JOIN features f ON f.contig = b.contig AND f.f_start = b.pos),
 m AS (SELECT query_name, min(read_index) FILTER (NOT is_read2) AS read1, min(read_index) FILTER (is_read2) AS read2 FROM reads GROUP BY query_name) SELECT h.*, read1, read2 FROM h JOIN m USING (query_name)""",
    "sequenced", "features", "reads",
)
def mate_pileup(spark, d):
    return pileup.mate_pileup(B.aligned_pieces(view(spark, d, "sequenced"), "query_name"), view(spark, d, "reads"), _places(spark, d))


@q(
    "coverage_at_places",
    f"WITH {_WALK} SELECT b.contig, pos, sm, count(*) AS n FROM bases b SEMI JOIN features f ON f.contig = b.contig AND f.f_start = b.pos WHERE NOT duplicate AND NOT qcfail GROUP BY ALL",
    "sequenced", "features",
)
def coverage_at_places(spark, d):
    return pileup.coverage_at(B.aligned_pieces(view(spark, d, "sequenced"), "sm", "duplicate", "qcfail"), _places(spark, d))


@q("region_bases", f"WITH {_WALK} SELECT sm, contig, pos, base, count(*) AS n FROM bases WHERE contig = 'chr2' AND pos >= 1000 AND pos < 5000 GROUP BY ALL", "sequenced")
def region_bases(spark, d):
    return pileup.in_region(B.aligned_bases(view(spark, d, "sequenced"), "sm"), "chr2", 1000, 5000).groupBy("sm", "contig", "pos", "base").agg(F.count("*").alias("n"))


_BOUNDS = """SELECT sm, contig, ds, rx, count(*) AS fragments, max(mapq) AS max_mapq, count(DISTINCT nh) AS reactions, max(end_) - min(start_) AS span, max(CASE WHEN proper THEN 1 ELSE 0 END) = 1 AS has_both
 FROM {0} WHERE NOT unmapped GROUP BY sm, contig, ds, rx"""


@q("molecule_bounds", f"SELECT * FROM ({_BOUNDS.format('reads')}) WHERE max_mapq >= 20 AND fragments <= 3 AND reactions BETWEEN 1 AND 2 AND span <= 50 AND has_both", "reads")
def molecule_bounds(spark, d):
    found = spark.sql(_BOUNDS.format("{r}"), r=view(spark, d, "reads"))
    return molecules.filtered(found, (None, 3), (20, None), (1, 2), (None, 50), True)


_GRID = "SELECT CAST(right(sm, 1) AS BIGINT) AS row, CAST(floor(start_ / 2500.0) AS BIGINT) AS col, CAST(count(*) AS DOUBLE) AS value FROM {0} GROUP BY 1, 2"
_MIRROR = "CASE WHEN ({0} % {1} + {1}) % {1} >= {2} THEN {1} - 1 - ({0} % {1} + {1}) % {1} ELSE ({0} % {1} + {1}) % {1} END"


@q(
    "smoothed_matrix",
    f"""WITH g AS ({_GRID.format('reads')}), kr AS (SELECT k, exp(-0.5 * k * k) AS w FROM range(-4, 5) t(k)), kc AS (SELECT k, exp(-0.125 * k * k) AS w FROM range(-8, 9) t(k)),
 wr AS (SELECT k, w / sum(w) OVER () AS w FROM kr), wc AS (SELECT k, w / sum(w) OVER () AS w FROM kc),
 a AS (SELECT r AS row, col, sum(value * w) AS value FROM range(10) t(r), wr JOIN g ON g.row = {_MIRROR.format('(r + k)', 20, 10)} GROUP BY ALL)
 SELECT row, c AS "column", round(sum(value * w), 6) AS value FROM range(40) t(c), wc JOIN a ON a.col = {_MIRROR.format('(c + k)', 80, 40)} GROUP BY ALL""",
    "reads",
)
def smoothed_matrix(spark, d):
    grid = spark.sql(_GRID.format("{r}"), r=view(spark, d, "reads")).withColumnRenamed("col", "column")
    return M.smoothed(grid, 10, 40, (1.0, 2.0)).withColumn("value", F.round("value", 6))


@q("differential_genes", None)
def differential_genes(spark, d):
    r = view(spark, d, "reads").select(F.col("sm").alias("cell"), F.split("gn", ",")[0].alias("gene"), "ly")
    counts = r.groupBy("cell", "gene").agg(F.count("*").alias("n"))
    cells = r.select("cell", F.col("ly").alias("plate"), F.pmod(F.substring_index("cell", "_", -1).cast("int"), F.lit(2)).alias("cluster")).distinct()
    return M.differential(counts, cells)


@q("complete_distances", None)
def complete_distances(spark, d):
    frame = view(spark, d, "reads").where("not unmapped").groupBy("sm", "contig", "ds").agg(F.avg(F.col("nm") / 3).alias("beta"))
    return M.complete_distances(calls.sample_distances(frame, "sm", ["contig", "ds"]), frame)


@q("flipped_strands", "SELECT contig, f_start, f_name, CASE f_strand WHEN '+' THEN '-' WHEN '-' THEN '+' ELSE '.' END AS strand FROM features", "features")
def flipped_strands(spark, d):
    return view(spark, d, "features").select("contig", "f_start", "f_name", S.inverted_strand(F.col("f_strand")).alias("strand"))
