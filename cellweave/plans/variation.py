"""Queries over aligned bases: observations, conversion calls, variants, copy-number profiles, and further statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import bases as B
from cellweave.operators import segmentation, statistics, variants
from cellweave.plans.registry import query
from cellweave.plans.views import sql, view

# -- the same walk in SQL, for the four CIGAR strings of the view -------------------------------------------------------

_WALK = """bases AS (SELECT * FROM (SELECT r.*, i, substr(r.seq, CAST(i + 1 AS INT), 1) AS base, ascii(substr(qual, CAST(i + 1 AS INT), 1)) - 33 AS qv,
 CASE WHEN is_reverse THEN length(r.seq) - 1 - i ELSE i END AS cycle,
 CASE WHEN cigar = '20M2I10M' AND i < 20 THEN start_ + i WHEN cigar = '20M2I10M' AND i >= 22 THEN start_ + i - 2 WHEN cigar = '5S30M' AND i >= 5 THEN start_ + i - 5
  WHEN cigar = '30M4S' AND i < 30 THEN start_ + i WHEN cigar = '40M' THEN start_ + i END AS pos
 FROM sequenced r, range(40) t(i) WHERE i < length(r.seq)) WHERE pos IS NOT NULL)"""
_CALLS = f"""{_WALK}, pieces AS (SELECT contig AS g_contig, k, greatest(k * 1000 - 2, 0) AS g_start, substr(seq, CAST(greatest(k * 1000 - 2, 0) + 1 AS INT), 1010) AS g_seq FROM genome, range(101) t(k)),
 around AS (SELECT b.*, CASE WHEN pos >= 2 AND pos + 2 < 100000 THEN substr(g_seq, CAST(pos - 1 - g_start AS INT), 5) END AS a FROM bases b LEFT JOIN pieces ON g_contig = contig AND k = CAST(floor(pos / 1000.0) AS BIGINT)),
 three AS (SELECT *, CASE WHEN is_reverse THEN reverse(translate(substr(a, 1, 3), 'ACGT', 'TGCA')) ELSE substr(a, 3, 3) END AS t FROM around),
 kinds AS (SELECT *, CASE WHEN t LIKE 'CG%' THEN 'z' WHEN regexp_matches(t, '^C[ACT]G') THEN 'x' WHEN regexp_matches(t, '^C[ACT][ACT]') THEN 'h' END AS k FROM three),
 symbols AS (SELECT *, coalesce(CASE WHEN base = CASE WHEN is_reverse THEN 'A' ELSE 'T' END THEN upper(k) WHEN base = CASE WHEN is_reverse THEN 'G' ELSE 'C' END THEN k END, '.') AS symbol FROM kinds)"""


def q(name: str, body: str | None, *views: str):
    return query(name, None if body is None else sql(body, *views))


def _bases(spark, d, *keep: str):
    return B.aligned_bases(view(spark, d, "sequenced"), *keep)


def _pieces(spark, d, *keep: str):
    return B.aligned_pieces(view(spark, d, "sequenced"), *keep)


def _placed(spark, d, *keep: str):
    return B.aligned_pieces(B.with_reference(view(spark, d, "sequenced"), B.reference_chunks(view(spark, d, "genome"))), *keep)


def _symbols(spark, d, *keep: str):
    return B.symbol_pieces(_placed(spark, d, *keep))


# -- bases ------------------------------------------------------------------------------------------------------------


@q(
    "base_observations",
    f"WITH {_WALK} SELECT sm, contig, pos, base, count(*) AS n, round(avg(qv), 6) AS mean_qual FROM bases WHERE qv >= 20 AND cycle >= 2 AND cycle < length(seq) - 3 GROUP BY ALL",
    "sequenced",
)
def base_observations(spark, d):
    # Stretches are dealt out by place: bases of a place then meet without moving.
    dealt = B.tiled(_pieces(spark, d, "sm")).repartition("sm", "contig", "_tile")
    bases = B.bases_of(dealt, "sm", "_tile").where(B.usable(20, 2, 3))
    return B.observations(bases, "sm", "_tile").drop("_tile").withColumn("mean_qual", F.round("mean_qual", 6))


@q(
    "dove_safe_bases",
    f"""WITH {_WALK}, e AS (SELECT query_name, max(contig) FILTER (is_read1) AS c1, max(contig) FILTER (NOT is_read1) AS c2, max(start_) FILTER (is_read1) AS s1, max(start_) FILTER (NOT is_read1) AS s2,
 max(end_) FILTER (is_read1) AS e1, max(end_) FILTER (NOT is_read1) AS e2, bool_or(is_reverse) FILTER (is_read1) AS r1, bool_or(is_reverse) FILTER (NOT is_read1) AS r2 FROM reads GROUP BY query_name),
 lim AS (SELECT query_name, CASE WHEN r1 THEN s2 ELSE s1 END AS lo, CASE WHEN r1 THEN e1 ELSE e2 END AS hi FROM e WHERE c1 = c2 AND r1 <> r2)
 SELECT sm, count(*) AS n FROM bases JOIN lim USING (query_name) WHERE pos >= lo AND pos < hi GROUP BY sm""",
    "reads", "sequenced",
)
def dove_safe_bases(spark, d):
    return B.safe_pieces(_pieces(spark, d, "sm", "query_name"), view(spark, d, "reads")).groupBy("sm").agg(F.sum("n").alias("n"))


# -- conversion calls -------------------------------------------------------------------------------------------------


@q("conversion_symbols", f"WITH {_CALLS} SELECT sm, symbol, count(*) AS n FROM symbols GROUP BY ALL", "sequenced", "genome")
def conversion_symbols(spark, d):
    return B.symbol_counts(_symbols(spark, d, "sm"), "sm")


_SUMS = ", ".join(f"count(*) FILTER (symbol = '{s}') AS n_{s}_{'methylated' if s.isupper() else 'plain'}" for s in B.SYMBOLS)


@q("molecule_methylation", f"WITH {_CALLS} SELECT query_name, contig, {_SUMS}, string_agg(symbol, '' ORDER BY pos, symbol) AS xm FROM symbols GROUP BY query_name, contig", "sequenced", "genome")
def molecule_methylation(spark, d):
    return B.molecule_totals(_symbols(spark, d, "query_name"), "query_name", "contig")


@q(
    "methylation_bins",
    f"""WITH {_CALLS}, z AS (SELECT sm, contig, CASE WHEN is_reverse THEN '-' ELSE '+' END AS strand, CASE WHEN is_reverse THEN pos + 1 ELSE pos END AS spot, symbol FROM symbols
  WHERE symbol IN ('z', 'Z') AND NOT EXISTS (SELECT 1 FROM variants v WHERE v.contig = symbols.contig AND v.pos = symbols.pos)),
 b AS (SELECT *, CAST(floor(spot / 5000.0) AS BIGINT) * 5000 AS bin FROM z)
 SELECT sm, contig, bin AS "start", bin + 5000 AS "end", strand, count(*) FILTER (symbol = 'Z') AS methylated, count(*) FILTER (symbol = 'z') AS unmethylated FROM b GROUP BY ALL""",
    "sequenced", "genome", "variants",
)
def methylation_bins(spark, d):
    unknown = B.at_places(_symbols(spark, d, "sm"), view(spark, d, "variants"), inside=False)
    return B.binned_methylation(B.called_bases(unknown, "zZ", "sm"), 5000, "z", stranded=True, dyad=True)


# -- variants ---------------------------------------------------------------------------------------------------------


@q("detected_alleles", f"WITH {_WALK} SELECT contig, pos, base, count(DISTINCT sm) AS cells FROM bases GROUP BY contig, pos, base HAVING count(DISTINCT sm) >= 3", "sequenced")
def detected_alleles(spark, d):
    dealt = B.tiled(_pieces(spark, d, "sm")).repartition("contig", "_tile")
    return variants.detected_alleles(B.bases_of(dealt, "sm", "_tile"), 3, "_tile")


@q(
    "variant_support",
    f"""WITH {_WALK}, v AS (SELECT DISTINCT contig, pos, ref, alt FROM variants)
 SELECT v.contig, v.pos, v.ref, v.alt, count(*) FILTER (base = ref) AS n_ref, count(*) FILTER (base = alt) AS n_alt, count(base) AS depth, count(*) FILTER (base = alt) >= 2 AS supported
 FROM v LEFT JOIN bases b ON b.contig = v.contig AND b.pos = v.pos GROUP BY ALL""",
    "sequenced", "variants",
)
def variant_support(spark, d):
    at = B.at_places(_pieces(spark, d), view(spark, d, "variants"))
    return variants.variant_support(B.bases_of(at, "_tile"), view(spark, d, "variants"))


_FLIP = "CASE WHEN ref IN ('A', 'G') THEN translate({0}, 'ACGT', 'TGCA') ELSE {1} END"


@q(
    "mutation_spectrum",
    f"""WITH k AS (SELECT sample, {_FLIP.format('substr(around, 3, 1)', 'substr(around, 1, 1)')} || '[' || {_FLIP.format('ref', 'ref')} || '>' || {_FLIP.format('alt', 'alt')} || ']' ||
 {_FLIP.format('substr(around, 1, 1)', 'substr(around, 3, 1)')} AS kind FROM variants WHERE ref <> alt), n AS (SELECT sample, kind, count(*) AS n FROM k GROUP BY ALL)
 SELECT sample, kind, n, round(n / sum(n) OVER (PARTITION BY sample), 6) AS share FROM n""",
    "variants",
)
def mutation_spectrum(spark, d):
    return variants.mutation_spectrum(view(spark, d, "variants"), "sample").withColumn("share", F.round("share", 6))


_MAPPED = """SELECT contig, f_start % 500 AS site, f_strand AS strand, CASE WHEN f_start % 7 = 0 THEN NULL ELSE contig END AS m_contig,
 CASE WHEN f_start % 7 = 0 THEN NULL WHEN f_start % 5 = 0 THEN (f_start + 100) % 500 ELSE f_start % 500 END AS m_site, CASE WHEN f_start % 7 = 0 THEN NULL ELSE f_strand END AS m_strand FROM {0}"""


@q(
    "site_mappability",
    f"""WITH m AS ({_MAPPED.format('features')}), o AS (SELECT *, coalesce(contig = m_contig AND site = m_site AND strand = m_strand, false) AS ok FROM m),
 e AS (SELECT contig, site, strand, ok::INT AS c, (NOT ok)::INT AS l, 0 AS w FROM o UNION ALL SELECT m_contig, m_site, m_strand, 0, 0, (NOT ok)::INT FROM o WHERE m_contig IS NOT NULL)
 SELECT contig, site, strand, sum(c) AS correct, sum(l) AS lost, sum(w) AS wrong_gain, sum(c) = 1 AND sum(l) = 0 AND sum(w) = 0 AS safe FROM e GROUP BY ALL""",
    "features",
)
def site_mappability(spark, d):
    return variants.site_mappability(spark.sql(_MAPPED.format("{f}"), f=view(spark, d, "features")))


# -- copy-number profiles ---------------------------------------------------------------------------------------------


def _counts(spark, d):
    """Reads by cell, contig and bin of 2 kb; bins are numbered along the genome."""
    r = view(spark, d, "reads").where("not unmapped")
    place = F.floor(F.col("start_") / 2000.0)
    return r.groupBy("sm", "contig", (F.substring("contig", 4, 9).cast("long") * 100 + place).alias("bin")).agg(F.count("*").alias("n"))


@q("copy_number_gc", None)
def copy_number_gc(spark, d):
    gc = 0.3 + F.pmod(F.col("bin") * 37, F.lit(40)) / 100.0
    return segmentation.gc_corrected(_counts(spark, d).withColumn("gc", gc), 10.0)


@q("copy_number_integers", None)
def copy_number_integers(spark, d):
    return segmentation.scale_to_integers(_counts(spark, d).withColumn("copies", F.col("n").cast("double")))


@q("copy_number_segments", None)
def copy_number_segments(spark, d):
    return segmentation.segments(_counts(spark, d).withColumn("copies", F.col("n").cast("double")), shuffles=200)


@q(
    "copy_number_clones",
    """WITH p AS (SELECT sm, contig, CAST(round_even(count(*) / 500.0, 0) AS BIGINT) AS copies FROM reads GROUP BY ALL), k AS (SELECT sm, string_agg(contig || copies, ',' ORDER BY contig) AS k FROM p GROUP BY sm),
 c AS (SELECT k, count(*) AS cells, min(sm) AS clone FROM k GROUP BY k HAVING count(*) >= 2) SELECT sm, clone, cells FROM k JOIN c USING (k)""",
    "reads",
)
def copy_number_clones(spark, d):
    n = view(spark, d, "reads").groupBy("sm", "contig").agg((F.count("*") / 500.0).alias("copies"))
    return segmentation.clones(n.withColumn("bin", F.lit(0)), 2)


# -- statistics -------------------------------------------------------------------------------------------------------


@q("fragment_sizes", "WITH e AS (SELECT query_name, contig, max(end_) - min(start_) AS size FROM reads WHERE NOT unmapped GROUP BY ALL) SELECT size, count(*) AS n FROM e GROUP BY size", "reads")
def fragment_sizes(spark, d):
    f = view(spark, d, "reads").where("not unmapped").groupBy("query_name", "contig").agg((F.max("end_") - F.min("start_")).alias("size"))
    return statistics.histogram(f, "size")


@q("reject_reasons", "SELECT ly, CASE WHEN unmapped THEN 'unmapped' WHEN qcfail THEN 'qcfail' END AS reason, count(*) AS n FROM reads WHERE is_read1 GROUP BY ALL", "reads")
def reject_reasons(spark, d):
    r = view(spark, d, "reads").withColumn("reason", F.when(F.col("unmapped"), "unmapped").when(F.col("qcfail"), "qcfail"))
    return statistics.by_value(r.where("is_read1"), "reason", "ly")


@q("tag_values", "SELECT coalesce(mp, 'Not demultiplexed') AS mp, count(*) AS n FROM reads GROUP BY 1", "reads")
def tag_values(spark, d):
    return statistics.by_value(view(spark, d, "reads"), "mp", missing="Not demultiplexed")


@q("trimmed_reads", "SELECT count(*) FILTER (nm = 1 OR nh = 3) AS trimmed, count(*) AS reads FROM reads", "reads")
def trimmed_reads(spark, d):
    r = view(spark, d, "reads").withColumn("tags", F.create_map(F.when(F.col("nm") == 1, "a1").otherwise("NM"), F.lit("x"), F.when(F.col("nh") == 3, "EB").otherwise("NH"), F.lit("x")))
    return statistics.trimmed(r)
