"""Queries of the reports: tags, contexts, plates, primers, nearest cuts, track differences, and filters of pairs and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import bases as B
from cellweave.operators import reports as R
from cellweave.operators import variants
from cellweave.plans.variation import _CALLS, _WALK, _placed, q
from cellweave.plans.views import view


@q(
    "tag_report",
    """WITH u AS (SELECT * FROM reads WHERE NOT duplicate), c AS (SELECT CASE WHEN ds IS NOT NULL THEN 'Assigned to cut site' END AS category FROM u UNION ALL SELECT CASE WHEN gn IS NOT NULL THEN 'Assigned to gene' END FROM u
 UNION ALL SELECT CASE nm WHEN 0 THEN 'Not assigned to exon' WHEN 1 THEN 'Assigned to exon' WHEN 2 THEN 'Overlapping with exon' END FROM u
 UNION ALL SELECT CASE nh WHEN 1 THEN 'Not assigned to gene/intron' WHEN 2 THEN 'Assigned to gene/intron' ELSE 'Unknown gene/intron assignment' END FROM u UNION ALL SELECT 'Library_' || ly FROM u)
 SELECT category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY category""",
    "reads",
)
def tag_report(spark, d):
    text = lambda c: F.col(c).cast("string")
    exon = F.when(F.col("nm") == 0, "Unassigned_NoFeatures").when(F.col("nm") == 1, "Assigned").when(F.col("nm") == 2, "other")
    gene = F.when(F.col("nh") == 1, "Unassigned_NoFeatures").when(F.col("nh") == 2, "Assigned").otherwise("other")
    tags = F.create_map(F.lit("DS"), text("ds"), F.lit("GN"), text("gn"), F.lit("EX"), exon, F.lit("XS"), gene, F.lit("LY"), text("ly"))
    return R.tag_report(view(spark, d, "reads").withColumn("tags", tags))


@q(
    "context_totals",
    f"WITH {_CALLS} SELECT sm, symbol, count(*) AS n FROM symbols WHERE is_read1 AND NOT duplicate AND NOT qcfail AND symbol <> '.' GROUP BY ALL",
    "sequenced", "genome",
)
def context_totals(spark, d):
    pieces = _placed(spark, d, "sm", "is_read1", "duplicate", "qcfail").where("is_read1 and not duplicate and not qcfail")
    return B.symbol_counts(B.symbol_pieces(pieces), "sm", symbols=B.SYMBOLS)


@q(
    "plate_quality",
    """WITH c AS (SELECT sm AS cell, count(*) AS total, count(*) FILTER (NOT duplicate AND NOT qcfail) AS molecules FROM reads GROUP BY sm),
 f AS (SELECT sm AS cell, round(avg((contig = 'chr5')::INT), 6) AS fraction FROM reads GROUP BY sm HAVING count(*) FILTER (contig = 'chr5') > 0)
 SELECT c.cell, total, molecules, coalesce(fraction, 0.0) AS fraction, CASE WHEN c.cell LIKE 'LIB0%' THEN 'first' END AS label, molecules >= 60 AND coalesce(fraction, 0.0) <= 0.2 AS passes FROM c LEFT JOIN f USING (cell)""",
    "reads",
)
def plate_quality(spark, d):
    r = view(spark, d, "reads").withColumn("cell", F.col("sm"))
    cells = r.groupBy("cell").agg(F.count("*").alias("total"), F.sum((~F.col("duplicate") & ~F.col("qcfail")).cast("long")).alias("molecules"))
    foreign = r.groupBy("cell").agg(F.round(F.avg((F.col("contig") == "chr5").cast("double")), 6).alias("fraction")).where("fraction > 0")
    labels = cells.where("cell like 'LIB0%'").select("cell", F.lit("first").alias("label"))
    return R.plate_quality(cells, foreign, labels, 60, 0.2)


@q(
    "primer_histogram",
    """SELECT CAST(floor(least(44, end_ - start_) / 10.0) AS BIGINT) * 10 AS size_bin, rx AS primer, count(*) AS n FROM reads WHERE NOT unmapped GROUP BY ALL""",
    "reads",
)
def primer_histogram(spark, d):
    return R.primer_histogram(view(spark, d, "reads").where("not unmapped"), F.col("end_") - F.col("start_"), 45, 10, "rx")


@q(
    "reaction_sizes",
    """WITH m AS (SELECT sm, gn, count(DISTINCT rx) AS reactions, avg(end_ - start_) AS s FROM reads WHERE NOT unmapped GROUP BY sm, gn)
 SELECT reactions, count(*) AS molecules, round(avg(s), 6) AS mean_size FROM m GROUP BY reactions""",
    "reads",
)
def reaction_sizes(spark, d):
    out = R.reaction_sizes(view(spark, d, "reads").where("not unmapped"), ["sm", "gn"], "rx", F.col("end_") - F.col("start_"))
    return out.withColumn("mean_size", F.round("mean_size", 6))


@q(
    "read_difference",
    """WITH a AS (SELECT DISTINCT query_name, is_read1 FROM reads WHERE mapq >= 10), b AS (SELECT DISTINCT query_name, is_read1 FROM reads WHERE NOT duplicate)
 SELECT query_name, is_read1, 'a' AS only_in FROM a ANTI JOIN b USING (query_name, is_read1) UNION ALL SELECT query_name, is_read1, 'b' FROM b ANTI JOIN a USING (query_name, is_read1)""",
    "reads",
)
def read_difference(spark, d):
    r = view(spark, d, "reads")
    return R.read_difference(r.where("mapq >= 10"), r.where("not duplicate"))


@q(
    "nearest_opposite_cuts",
    """WITH s AS (SELECT DISTINCT sm, contig, is_reverse, ds AS p FROM reads), k AS (SELECT sm, contig FROM s GROUP BY ALL HAVING count(*) FILTER (is_reverse) > 1 AND count(*) FILTER (NOT is_reverse) > 1),
 d AS (SELECT s.*, min(p) FILTER (is_reverse) OVER u AS ra, max(p) FILTER (is_reverse) OVER l AS rb, min(p) FILTER (NOT is_reverse) OVER u AS fa, max(p) FILTER (NOT is_reverse) OVER l AS fb FROM s JOIN k USING (sm, contig)
  WINDOW u AS (PARTITION BY sm, contig ORDER BY p RANGE BETWEEN 1 FOLLOWING AND 499 FOLLOWING), l AS (PARTITION BY sm, contig ORDER BY p RANGE BETWEEN 499 PRECEDING AND 1 PRECEDING)),
 x AS (SELECT 'forward_above' AS kind, ra - p AS distance FROM d WHERE NOT is_reverse UNION ALL SELECT 'forward_below', p - rb FROM d WHERE NOT is_reverse
  UNION ALL SELECT 'reverse_above', fa - p FROM d WHERE is_reverse UNION ALL SELECT 'reverse_below', p - fb FROM d WHERE is_reverse)
 SELECT kind, distance, count(*) AS n FROM x WHERE distance IS NOT NULL GROUP BY ALL""",
    "reads",
)
def nearest_opposite_cuts(spark, d):
    return R.nearest_opposite(view(spark, d, "reads"), 500, size=1 << 12)


@q(
    "track_difference",
    """WITH b AS (SELECT contig, CAST(floor(start_ / 1000.0) AS BIGINT) * 1000 AS bin_start, is_reverse, count(*) AS n FROM reads GROUP BY ALL),
 f AS (SELECT * FROM b WHERE NOT is_reverse), r AS (SELECT * FROM b WHERE is_reverse)
 SELECT contig, bin_start, bin_start + 1000 AS bin_end, abs(f.n - r.n) AS difference FROM f FULL JOIN r USING (contig, bin_start)""",
    "reads",
)
def track_difference(spark, d):
    start = (F.floor(F.col("start_") / 1000.0) * 1000).alias("bin_start")
    b = view(spark, d, "reads").groupBy("contig", start, "is_reverse").agg(F.count("*").alias("n")).withColumn("bin_end", F.col("bin_start") + 1000)
    return R.track_difference(b.where("not is_reverse"), b.where("is_reverse"))


@q(
    "pair_filter",
    """WITH k AS (SELECT query_name FROM sequenced GROUP BY query_name HAVING min(mapq) >= 20 AND max(mapq) > 0 AND NOT bool_or(regexp_matches(seq, 'AAA|CCC|GGG|TTT')))
 SELECT read_index, query_name, mapq FROM sequenced WHERE query_name IN (SELECT query_name FROM k)""",
    "sequenced",
)
def pair_filter(spark, d):
    return R.pair_filter(view(spark, d, "sequenced"), 20, homopolymer=3).select("read_index", "query_name", "mapq")


@q(
    "allele_frequency",
    """WITH c AS (SELECT sample, contig, pos, pos % 7 AS ad_ref, pos % 4 AS ad_alt FROM variants)
 SELECT sample, contig, pos, ad_ref, ad_alt FROM c WHERE ad_ref + ad_alt > 0 AND ad_ref / (ad_ref + ad_alt)::DOUBLE BETWEEN 0.25 AND 0.75""",
    "variants",
)
def allele_frequency(spark, d):
    calls = view(spark, d, "variants").select("sample", "contig", "pos", F.pmod("pos", F.lit(7)).alias("ad_ref"), F.pmod("pos", F.lit(4)).alias("ad_alt"))
    return R.frequency_filter(calls, 0.25)


@q(
    "heterozygous_variants",
    f"""WITH {_WALK}, v AS (SELECT DISTINCT contig, pos, ref, alt FROM variants),
 s AS (SELECT v.contig, v.pos, v.ref, v.alt, count(*) FILTER (base = alt) AS n_alt, count(base) AS depth FROM v LEFT JOIN bases b ON b.contig = v.contig AND b.pos = v.pos GROUP BY ALL)
 SELECT * FROM s WHERE depth > 0 AND n_alt / depth::DOUBLE > 0.3""",
    "sequenced", "variants",
)
def heterozygous_variants(spark, d):
    at = B.at_places(B.aligned_pieces(view(spark, d, "sequenced")), view(spark, d, "variants"))
    support = variants.variant_support(B.bases_of(at, "_tile"), view(spark, d, "variants"))
    return R.heterozygous(support).select("contig", "pos", "ref", "alt", "n_alt", "depth")


@q("position_quality", f"WITH {_WALK} SELECT contig, pos, round(avg(cycle), 6) AS mean_cycle, round(avg(qv), 6) AS mean_qual, count(*) AS depth FROM bases GROUP BY contig, pos", "sequenced")
def position_quality(spark, d):
    g = B.aligned_bases(view(spark, d, "sequenced")).groupBy("contig", "pos")
    return g.agg(F.round(F.avg("cycle"), 6).alias("mean_cycle"), F.round(F.avg("qual"), 6).alias("mean_qual"), F.count("*").alias("depth"))
