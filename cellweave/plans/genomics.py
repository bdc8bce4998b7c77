"""Queries of the read operators over the genomic views, with the SQL of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import sequence as S
from cellweave.operators import barcodes, calls, counting, filters, fragments, intervals, molecules, statistics, windows
from cellweave.plans.registry import query
from cellweave.plans.views import sql, view

_LEN = 100_000


def q(name: str, body: str | None, *views: str):
    return query(name, None if body is None else sql(body, *views))


# -- filters ----------------------------------------------------------------------------------------------------------

_COUNTED = """NOT qcfail AND mapq >= 10 AND proper AND NOT regexp_matches(cigar, '[ID]') AND (nm IS NULL OR nm <= 2) AND NOT contains(cigar, 'S')
 AND NOT unmapped AND NOT duplicate AND coalesce(mp = 'unique', false)
 AND NOT coalesce(len(list_filter(string_split(coalesce(xa, ''), ';'), lambda x: x <> '' AND NOT ends_with(string_split(x, ',')[1], '_alt'))) > 0, false)"""


@q("read_filter", f"SELECT sm, count(*) AS n FROM reads WHERE {_COUNTED} GROUP BY sm", "reads")
def read_filter(spark, d):
    keep = filters.counted(mappable=True, min_mapq=10, proper=True, no_indels=True, max_edits=2, no_clips=True, no_alternative=True, dedup=True)
    return view(spark, d, "reads").where(keep).groupBy("sm").agg(F.count("*").alias("n"))


@q("r1_and_r2_only", "SELECT sm, count(*) FILTER (NOT is_read2) AS r1, count(*) FILTER (NOT is_read1) AS r2 FROM reads WHERE NOT qcfail AND NOT unmapped GROUP BY sm", "reads")
def r1_and_r2_only(spark, d):
    n = lambda keep: F.count(F.when(keep, 1))
    return view(spark, d, "reads").groupBy("sm").agg(n(filters.counted(r1_only=True)).alias("r1"), n(filters.counted(r2_only=True)).alias("r2"))


@q("binned_filter", "SELECT contig, count(*) AS n FROM reads WHERE mapq >= 20 AND NOT qcfail AND (mp IS NULL OR mp = 'unique') AND NOT duplicate AND is_read1 GROUP BY contig", "reads")
def binned_filter(spark, d):
    return view(spark, d, "reads").where(filters.binned_filter(20, True, True)).groupBy("contig").agg(F.count("*").alias("n"))


@q(
    "cut_filters",
    """SELECT 'loose' AS kind, count(*) AS n FROM reads WHERE is_read1 AND NOT qcfail
 UNION ALL SELECT 'default', count(*) FROM reads WHERE is_read1 AND NOT qcfail AND NOT duplicate AND mapq >= 30
 UNION ALL SELECT 'strict', count(*) FROM reads WHERE is_read1 AND NOT qcfail AND NOT duplicate AND mapq >= 50 AND NOT regexp_matches(cigar, '[SI]') AND proper AND nm <= 1""",
    "reads",
)
def cut_filters(spark, d):
    r = view(spark, d, "reads")
    out = [r.where(filters.cut_filter(k)).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("loose", "default", "strict")]
    return out[0].union(out[1]).union(out[2])


@q(
    "blacklist_filter",
    """SELECT contig, count(*) AS n FROM reads r WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.contig = r.contig AND
 ((r.start_ >= b.b_start AND r.start_ < b.b_end) OR (r.end_ >= b.b_start AND r.end_ < b.b_end))) GROUP BY contig""",
    "reads", "blacklist",
)
def blacklist_filter(spark, d):
    return filters.without_blacklisted(view(spark, d, "reads"), view(spark, d, "blacklist")).groupBy("contig").agg(F.count("*").alias("n"))


@q(
    "soft_clip_filter",
    """SELECT cigar, count(*) AS n FROM (SELECT cigar, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)S', 1), lambda x: x::int)), 0) AS s,
 coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)M', 1), lambda x: x::int)), 0) AS m FROM reads) WHERE s / (s + m)::double < 0.12 GROUP BY cigar""",
    "reads",
)
def soft_clip_filter(spark, d):
    return view(spark, d, "reads").where(filters.soft_clip_filter(0.12)).groupBy("cigar").agg(F.count("*").alias("n"))


@q("expression_filter", "SELECT sm, count(*) AS n FROM reads WHERE mapq > 30 AND rx LIKE 'A%' GROUP BY sm", "reads")
def expression_filter(spark, d):
    return filters.expression(view(spark, d, "reads"), "mapq > 30 AND rx LIKE 'A%'").groupBy("sm").agg(F.count("*").alias("n"))


# -- count tables -----------------------------------------------------------------------------------------------------

_BASIC = "NOT qcfail AND NOT unmapped AND NOT duplicate"
_FEATURE_TAGS = "SELECT sm, contig AS f_contig, coalesce(mp, 'None') AS f_mp, sum(0.5) AS n FROM reads WHERE " + _BASIC + " GROUP BY ALL"


@q("count_table", _FEATURE_TAGS, "reads")
def count_table(spark, d):
    r = view(spark, d, "reads").where(filters.counted(dedup=True))
    return counting.joined_features(r, ["sm"], ["contig", "mp"], counting.weight())


@q("count_separate_features", f"SELECT sm, feature, sum(w) AS n FROM (SELECT sm, 0.5 AS w, unnest([contig, coalesce(mp, 'None'), nh::varchar]) AS feature FROM reads WHERE {_BASIC}) GROUP BY ALL", "reads")
def count_separate_features(spark, d):
    return counting.separate_features(view(spark, d, "reads").where(filters.counted(dedup=True)), ["sm"], ["contig", "mp", "nh"], counting.weight())


@q("count_split_features", f"SELECT sm, f_gn, contig AS f_contig, count(*) AS n FROM (SELECT sm, contig, unnest(string_split(gn, ',')) AS f_gn FROM reads WHERE {_BASIC}) GROUP BY ALL", "reads")
def count_split_features(spark, d):
    r = view(spark, d, "reads").where(filters.counted(dedup=True))
    return counting.split_features(r, ["sm"], ["gn", "contig"], ",", F.lit(1)).select("sm", "f_gn", "f_contig", "n")


@q("count_multimapping", "SELECT sm, round(sum(0.5 / CASE WHEN xa IS NOT NULL THEN len(string_split(xa, ';')) ELSE nh END), 6) AS n FROM reads GROUP BY sm", "reads")
def count_multimapping(spark, d):
    return view(spark, d, "reads").groupBy("sm").agg(F.round(F.sum(counting.weight(True, True)), 6).alias("n"))


@q("count_by_value", "SELECT sm, sum(coalesce(try_cast(value_ AS double), 0)) AS n FROM reads GROUP BY sm", "reads")
def count_by_value(spark, d):
    return counting.by_value(view(spark, d, "reads"), ["sm"], "value_")


_BIN = """SELECT sm, contig, b * {step} AS bin_start, b * {step} + {size} AS bin_end, sum(0.5) AS n FROM (
 SELECT sm, contig, unnest(generate_series(CAST(ceil((ds - {size}) / {step}.0) AS BIGINT), CAST(floor(ds / {step}.0) AS BIGINT))) AS b FROM reads WHERE """ + _BASIC + """)
 WHERE b >= 0 AND b * {step} + {size} <= 100000 GROUP BY ALL"""


@q("count_sliding_bins", _BIN.format(size=2000, step=500), "reads")
def count_sliding_bins(spark, d):
    return counting.binned(view(spark, d, "reads").where(filters.counted(dedup=True)), view(spark, d, "contigs"), ["sm"], 2000, 500, counting.weight())


@q("count_fixed_bins", _BIN.format(size=1000, step=1000), "reads")
def count_fixed_bins(spark, d):
    return counting.binned(view(spark, d, "reads").where(filters.counted(dedup=True)), view(spark, d, "contigs"), ["sm"], 1000, 1000, counting.weight())


@q("count_bed_regions", "SELECT ly, r.contig, f_start, f_end, f_name, sum(0.5) AS n FROM reads r JOIN features f ON r.contig = f.contig AND greatest(start_, f_start) < least(end_, f_end) GROUP BY ALL", "reads", "features")
def count_bed_regions(spark, d):
    return counting.by_region(view(spark, d, "reads"), view(spark, d, "features"), ["ly"], counting.weight())


@q("count_region_sites", "SELECT ly, f_name, count(*) AS n FROM reads r JOIN features f ON r.contig = f.contig AND greatest(start_, f_start) < least(end_, f_end) AND ds BETWEEN f_start AND f_end GROUP BY ALL", "reads", "features")
def count_region_sites(spark, d):
    return counting.region_sites(view(spark, d, "reads"), view(spark, d, "features"), ["ly"])


@q("count_bulk", f"SELECT contig AS f_contig, coalesce(mp, 'None') AS f_mp, sum(0.5) AS n FROM reads WHERE {_BASIC} GROUP BY ALL", "reads")
def count_bulk(spark, d):
    return counting.bulk(count_table(spark, d), ["sm"])


@q("count_matrix", "SELECT sm, " + ", ".join(f"sum(1) FILTER (contig = 'chr{k}') AS chr{k}" for k in range(1, 6)) + " FROM reads GROUP BY sm", "reads")
def count_matrix(spark, d):
    t = view(spark, d, "reads").groupBy("sm", "contig").agg(F.count("*").alias("n"))
    return counting.matrix(t, ["sm"], "contig", [f"chr{k}" for k in range(1, 6)])


@q(
    "overseq",
    "SELECT contig, bin_start, sm, copies, count(*) AS molecules FROM (SELECT contig, CAST(floor(ds / 5000.0) * 5000 AS BIGINT) AS bin_start, sm, count(*) AS copies FROM reads GROUP BY contig, bin_start, sm, ds, is_reverse, rx) GROUP BY ALL",
    "reads",
)
def overseq(spark, d):
    return counting.overseq(view(spark, d, "reads"), 5000)


# -- joins ------------------------------------------------------------------------------------------------------------


def _spans(spark, d, *more: str):
    """Features with the columns that a join needs; all that it is given goes into its lists."""
    return view(spark, d, "features").select("contig", "f_start", "f_end", "f_name", *more)


@q("interval_join", "SELECT read_index, f_name FROM reads r JOIN features f ON r.contig = f.contig AND ds BETWEEN f_start AND f_end", "reads", "features")
def interval_join(spark, d):
    return intervals.points_in(view(spark, d, "reads"), _spans(spark, d)).select("read_index", "f_name")


@q("interval_join_stranded", "SELECT read_index, f_name FROM reads r JOIN features f ON r.contig = f.contig AND ds BETWEEN f_start AND f_end AND f_strand = CASE WHEN is_reverse THEN '-' ELSE '+' END", "reads", "features")
def interval_join_stranded(spark, d):
    return intervals.points_in(view(spark, d, "reads"), _spans(spark, d, "f_strand"), strand=True).select("read_index", "f_name")


@q("overlap_join", "SELECT read_index, f_name FROM reads r JOIN features f ON r.contig = f.contig AND greatest(start_, f_start) <= least(end_, f_end)", "reads", "features")
def overlap_join(spark, d):
    return intervals.overlaps(view(spark, d, "reads"), _spans(spark, d)).select("read_index", "f_name")


@q("both_ends_join", "SELECT read_index, f_name FROM reads r JOIN features f ON r.contig = f.contig AND f_start <= start_ AND f_end >= end_", "reads", "features")
def both_ends_join(spark, d):
    return intervals.covering_both_ends(view(spark, d, "reads"), _spans(spark, d)).select("read_index", "f_name")


@q(
    "nearest_feature",
    """SELECT read_index, l.f_end AS left_end, r2.f_start AS right_start, ds - l.f_end AS left_distance, r2.f_start - ds AS right_distance FROM reads r
 ASOF LEFT JOIN (SELECT DISTINCT contig, f_end FROM features) l ON r.contig = l.contig AND r.ds >= l.f_end
 ASOF LEFT JOIN (SELECT DISTINCT contig, f_start FROM features) r2 ON r.contig = r2.contig AND r.ds <= r2.f_start""",
    "reads", "features",
)
def nearest_feature(spark, d):
    return intervals.nearest(view(spark, d, "reads"), view(spark, d, "features"))


@q(
    "band_join",
    "SELECT a.sm, a.contig, a.ds AS fwd, b.ds AS rev FROM reads a JOIN reads b ON a.sm = b.sm AND a.contig = b.contig AND NOT a.is_reverse AND b.is_reverse AND b.ds > a.ds AND b.ds - a.ds < 300",
    "reads",
)
def band_join(spark, d):
    return intervals.band_pairs(view(spark, d, "reads"), 300)


_PAIRS = """pairs AS (SELECT query_name, min(r) FILTER (is_read1) AS r1, min(r) FILTER (NOT is_read1) AS r2 FROM (SELECT query_name, read_index, is_read1,
 {'read_index': read_index, 'contig': contig, 'start_': start_, 'end_': end_, 'is_reverse': is_reverse, 'mapq': mapq, 'cigar': cigar, 'sm': sm, 'rx': rx} AS r FROM reads) GROUP BY query_name)"""


@q(
    "mate_pairing",
    f"WITH {_PAIRS} SELECT query_name, r1.read_index AS r1, r2.read_index AS r2, r1 IS NOT NULL AND r2 IS NOT NULL AS paired FROM pairs",
    "reads",
)
def mate_pairing(spark, d):
    p = fragments.pair(view(spark, d, "reads"))
    return p.select("query_name", F.col("r1.read_index").alias("r1"), F.col("r2.read_index").alias("r2"), (F.col("r1").isNotNull() & F.col("r2").isNotNull()).alias("paired"))


_SITE = """CASE WHEN o.is_reverse THEN o.end_ + 1 + coalesce(try_cast(nullif(regexp_extract(o.cigar, '(\\d+)S$', 1), '') AS INT), 0)
 ELSE o.start_ - 2 - coalesce(try_cast(nullif(regexp_extract(o.cigar, '^(\\d+)S', 1), '') AS INT), 0) END"""
_FRAGMENTS = f"""{_PAIRS}, fr AS (SELECT query_name, coalesce(r1.sm, r2.sm) AS sm, coalesce(r2.rx, r1.rx) AS rx, o.contig AS contig, coalesce(r1.is_reverse, NOT r2.is_reverse) AS is_reverse,
 greatest(coalesce(r1.mapq, r2.mapq), coalesce(r2.mapq, r1.mapq)) AS mapq,
 CASE WHEN same_contig THEN least(r1.start_, r2.start_) ELSE o.start_ END AS start_,
 CASE WHEN same_contig AND r1.is_reverse = r2.is_reverse THEN greatest(r1.start_, r2.start_) WHEN same_contig THEN greatest(r1.end_, r2.end_) ELSE o.end_ END AS end_,
 (same_contig AND r1.is_reverse <> r2.is_reverse) OR NOT same_contig AS safe, {_SITE} AS site, o.read_index AS read_index, r1 IS NOT NULL AND r2 IS NOT NULL AS paired
 FROM (SELECT *, coalesce(r1, r2) AS o, coalesce(r1.contig = r2.contig, false) AS same_contig FROM pairs))"""


@q("fragments", f"WITH {_FRAGMENTS} SELECT * FROM fr", "reads")
def fragment_table(spark, d):
    return fragments.fragments(fragments.pair(view(spark, d, "reads")))


# -- molecules --------------------------------------------------------------------------------------------------------


def _sites(spark, d):
    return view(spark, d, "reads").withColumn("site", (F.col("start_") % 200).cast("long"))


@q(
    "molecule_exact",
    """SELECT read_index, min(read_index) OVER w AS molecule, count(*) OVER w AS af, row_number() OVER (PARTITION BY sm, contig, is_reverse, start_ % 200, rx ORDER BY read_index) - 1 AS rc
 FROM reads WINDOW w AS (PARTITION BY sm, contig, is_reverse, start_ % 200, rx)""",
    "reads",
)
def molecule_exact(spark, d):
    return molecules.exact(_sites(spark, d), "sm", "contig", "is_reverse", "site", "rx").select("read_index", "molecule", "af", "rc")


@q("molecule_tolerant", None)
def molecule_tolerant(spark, d):
    return molecules.assign(_sites(spark, d), ["sm", "contig", "is_reverse"], radius=1, hamming=1)


@q(
    "molecule_table",
    """SELECT sm, contig, is_reverse, start_ % 200 AS site_key, rx, count(*) AS fragments, min(start_) AS span_start, max(end_) AS span_end, max(mapq) AS max_mapq, CASE WHEN is_reverse THEN max(start_ + nm) ELSE min(start_ + nm) END AS consensus_site, min(read_index) AS molecule,
 CASE WHEN max(mapq) = 0 THEN 'multimapping' WHEN max(mapq) < 20 THEN 'MQ' END AS rr FROM reads GROUP BY sm, contig, is_reverse, start_ % 200, rx HAVING count(*) >= 1 AND max(mapq) >= 5""",
    "reads",
)
def molecule_table(spark, d):
    s = _sites(spark, d).withColumnRenamed("site", "site_key").withColumn("site", F.col("start_") + F.col("nm"))
    m = molecules.molecules(s, "sm", "contig", "is_reverse", "site_key", "rx")
    return m.where(molecules.valid(1, 5)).withColumn("rr", molecules.rejection())


@q("common_umi", "SELECT sm, rx, n FROM (SELECT sm, rx, count(*) AS n, row_number() OVER (PARTITION BY sm ORDER BY count(*) DESC, min(read_index)) AS k FROM reads GROUP BY sm, rx) WHERE k = 1", "reads")
def common_umi(spark, d):
    return molecules.most_common(view(spark, d, "reads"), "rx", "sm")


@q("duplication_rate", "SELECT sm, count(*) / nullif(count(*) FILTER (NOT duplicate), 0)::double AS rate FROM reads GROUP BY sm", "reads")
def duplication_rate(spark, d):
    return molecules.duplication_rate(view(spark, d, "reads"), "sm")


@q(
    "rt_reactions",
    """SELECT read_index, dense_rank() OVER (PARTITION BY sm, contig, start_ % 200 ORDER BY end_, nm) - 1 AS rt,
 row_number() OVER (PARTITION BY sm, contig, start_ % 200, end_, nm ORDER BY read_index) - 1 AS rd FROM reads""",
    "reads",
)
def rt_reactions(spark, d):
    return molecules.reactions(_sites(spark, d), ["sm", "contig", "site"], ["end_", "nm"]).select("read_index", "rt", "rd")


# -- bins and distances -----------------------------------------------------------------------------------------------

_MERGED = """merged AS (SELECT contig, min(b_start) AS start_, max(b_end) AS end_ FROM (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY b_start, b_end ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, CASE WHEN b_start < max(b_end) OVER (PARTITION BY contig ORDER BY b_start, b_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM blacklist)) GROUP BY contig, g)"""
_GAPS = _MERGED + """, gaps AS (SELECT contig, coalesce(max(end_) OVER (PARTITION BY contig ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start, start_ AS gap_end
 FROM (SELECT * FROM merged UNION ALL SELECT contig, length_, length_ FROM contigs) QUALIFY gap_start < gap_end)"""


@q("merged_ranges", f"WITH {_MERGED} SELECT * FROM merged", "blacklist")
def merged_ranges(spark, d):
    return windows.merged_ranges(view(spark, d, "blacklist"), "b_start", "b_end")


@q("gaps", f"WITH {_GAPS} SELECT * FROM gaps", "blacklist", "contigs")
def gap_table(spark, d):
    return windows.gaps(merged_ranges(spark, d), view(spark, d, "contigs"))


@q(
    "blacklisted_bins",
    f"""WITH {_GAPS}, n AS (SELECT *, gap_end - gap_start AS w, CAST(ceil((gap_end - gap_start) / 3000.0) AS BIGINT) AS k FROM gaps), i AS (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM n),
 b AS (SELECT contig, gap_start + CAST(floor(i * w / k::double) AS BIGINT) AS bin_start, gap_start + CAST(floor((i + 1) * w / k::double) AS BIGINT) AS bin_end, gap_start, gap_end FROM i)
 SELECT contig, bin_start, bin_end, greatest(bin_start - 500, gap_start) AS fetch_start, least(bin_end + 500, gap_end) AS fetch_end FROM b""",
    "blacklist", "contigs",
)
def blacklisted_bins(spark, d):
    return windows.blacklisted_bins(merged_ranges(spark, d), view(spark, d, "contigs"), 3000, 500)


@q(
    "adjacent_distances",
    "SELECT distance, count(*) AS n FROM (SELECT ds - lag(ds) OVER (PARTITION BY contig, sm ORDER BY ds) AS distance FROM (SELECT DISTINCT contig, sm, ds FROM reads)) WHERE distance > 0 AND distance < 2000 GROUP BY distance",
    "reads",
)
def adjacent_distances(spark, d):
    return windows.adjacent_distances(view(spark, d, "reads"), 0, 2000, "contig", "sm")


@q(
    "rolling_mean",
    """SELECT contig, bin, round(s, 6) AS smooth FROM (SELECT contig, bin, avg(n) OVER w AS s, count(*) OVER w AS c FROM (SELECT contig, CAST(floor(ds / 1000.0) * 1000 AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY ALL)
 WINDOW w AS (PARTITION BY contig ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE c = 7""",
    "reads",
)
def rolling_mean(spark, d):
    n = view(spark, d, "reads").groupBy("contig", windows.tumbling_bin(F.col("ds"), 1000).alias("bin")).agg(F.count("*").alias("n"))
    return windows.rolling_mean(n, "n", "bin", 3, "contig").select("contig", "bin", F.round("smooth", 6).alias("smooth"))


@q("z_scores", "SELECT contig, sm, round((n - avg(n) OVER w) / nullif(stddev_pop(n) OVER w, 0), 6) AS z FROM (SELECT contig, sm, count(*) AS n FROM reads GROUP BY ALL) WINDOW w AS (PARTITION BY contig)", "reads")
def z_scores(spark, d):
    n = view(spark, d, "reads").groupBy("contig", "sm").agg(F.count("*").alias("n"))
    return windows.z_scores(n, "n", "contig").select("contig", "sm", F.round("z", 6).alias("z"))


@q(
    "consecutive_runs",
    "SELECT contig, min(ds) AS run_start, max(ds) AS run_end FROM (SELECT contig, ds, ds - row_number() OVER (PARTITION BY contig ORDER BY ds) AS g FROM (SELECT DISTINCT contig, ds FROM reads)) GROUP BY contig, g",
    "reads",
)
def consecutive_runs(spark, d):
    return windows.consecutive_runs(view(spark, d, "reads"), "ds", "contig")


@q(
    "nucleosome_votes",
    """SELECT contig, CAST(floor((ds + nxt) / 2.0 / 10.0) * 10 AS BIGINT) AS bin_start, count(*) AS votes FROM (SELECT sm, contig, ds, lead(ds) OVER (PARTITION BY sm, contig ORDER BY ds) AS nxt
 FROM (SELECT DISTINCT sm, contig, ds FROM reads)) WHERE nxt - ds BETWEEN 100 AND 200 GROUP BY ALL""",
    "reads",
)
def nucleosome_votes(spark, d):
    return windows.nucleosome_votes(view(spark, d, "reads"))


# -- scalar functions -------------------------------------------------------------------------------------------------

_REV = "reverse(translate({}, 'ATCGNatcgn', 'TAGCNtagcn'))"


@q(
    "sequence_functions",
    f"""SELECT read_index, {_REV.format('rx')} AS rc, (length(rx) - length(regexp_replace(rx, '[GC]', '', 'g'))) / length(rx)::double AS gc,
 len(list_filter(range(1, 4), lambda i: substr(rx, i, 1) <> substr({_REV.format('rx')}, i, 1))) AS hd, regexp_replace(gn, '[^a-zA-Z0-9\\-_.]', '', 'g') AS safe, split_part(gn, ',', 1) AS head,
 regexp_matches(rx, 'AA|CC|GG|TT') AS poly FROM reads""",
    "reads",
)
def sequence_functions(spark, d):
    rx, gn = F.col("rx"), F.col("gn")
    return view(spark, d, "reads").select(
        "read_index", S.reverse_complement(rx).alias("rc"), S.gc_ratio(rx).alias("gc"), S.hamming(rx, S.reverse_complement(rx)).alias("hd"), S.safe_text(gn).alias("safe"),
        S.split_nth(gn, ",", 1)[0].alias("head"), S.homopolymer(rx, 2).alias("poly"),
    )


@q(
    "cigar_functions",
    """SELECT cigar, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MI]', 1), lambda x: x::int)), 0) AS mi, coalesce(try_cast(nullif(regexp_extract(cigar, '^(\\d+)S', 1), '') AS INT), 0) AS lead_,
 coalesce(try_cast(nullif(regexp_extract(cigar, '(\\d+)S$', 1), '') AS INT), 0) AS trail, count(*) AS n FROM reads GROUP BY cigar""",
    "reads",
)
def cigar_functions(spark, d):
    c = F.col("cigar")
    return view(spark, d, "reads").groupBy("cigar").agg(F.count("*").alias("n")).select("cigar", S.cigar_total(c, "MI").cast("long").alias("mi"), S.leading_clip(c).alias("lead_"), S.trailing_clip(c).alias("trail"), "n")


@q("phred_functions", "SELECT DISTINCT mapq, round(pow(10, -mapq / 10.0), 9) AS p, CAST(least(60, mapq) AS INT) AS back FROM reads", "reads")
def phred_functions(spark, d):
    p = S.phred_to_probability(F.char(F.col("mapq") + 33))
    return view(spark, d, "reads").select("mapq").distinct().select("mapq", F.round(p, 9).alias("p"), S.probability_to_phred(1 - p).alias("back"))


# -- barcodes ---------------------------------------------------------------------------------------------------------


def _whitelist(spark, d):
    r = view(spark, d, "reads").select(F.col("rx").alias("barcode")).distinct().where("substr(barcode, 1, 1) = 'A' AND substr(barcode, 3, 1) IN ('A', 'C')")
    return r.withColumn("index", F.ascii(F.substring("barcode", 2, 1)) * 10 + F.ascii(F.substring("barcode", 3, 1)))


_EXPAND = """wl AS (SELECT DISTINCT rx AS barcode, ascii(substr(rx, 2, 1)) * 10 + ascii(substr(rx, 3, 1)) AS "index" FROM reads WHERE substr(rx, 1, 1) = 'A' AND substr(rx, 3, 1) IN ('A', 'C')),
 l(c) AS (VALUES ('A'), ('C'), ('T'), ('G'), ('N')), w AS (SELECT a.c || b.c || e.c AS observed FROM l a, l b, l e),
 dd AS (SELECT observed, barcode, "index", len(list_filter(range(1, 4), lambda i: substr(observed, i, 1) <> substr(barcode, i, 1))) AS hd FROM w, wl),
 ex AS (SELECT observed, barcode, "index", hd FROM dd WHERE hd <= 1 QUALIFY hd = min(hd) OVER (PARTITION BY observed) AND count(*) OVER (PARTITION BY observed, hd) = 1)"""


@q("barcode_expansion", f"WITH {_EXPAND} SELECT * FROM ex", "reads")
def barcode_expansion(spark, d):
    return barcodes.expanded(_whitelist(spark, d), 1)


@q("barcode_correction", f"WITH {_EXPAND} SELECT barcode, hd, count(*) AS n FROM reads LEFT JOIN ex ON rx = observed GROUP BY ALL", "reads")
def barcode_correction(spark, d):
    return barcodes.corrected(view(spark, d, "reads"), barcode_expansion(spark, d), "rx").groupBy("barcode", "hd").agg(F.count("*").alias("n"))


@q(
    "demultiplex",
    """WITH w AS (SELECT DISTINCT 'ACG' || rx || 'TT' AS barcode, ascii(substr(rx, 2, 1)) * 10 + ascii(substr(rx, 3, 1)) AS i FROM reads WHERE substr(rx, 1, 1) = 'A' AND substr(rx, 3, 1) IN ('A', 'C')),
 p AS (SELECT read_index, substr(r1, 1, 3) AS rx, substr(r1, 4, 8) AS raw_barcode, substr(r1, 12) AS rest1, substr(r2, 7) AS rest2 FROM (SELECT read_index, rx || 'ACG' || rx || 'TT' || contig AS r1, gn || cigar AS r2 FROM reads)),
 m AS (SELECT raw_barcode, barcode, i, len(list_filter(range(1, 9), lambda k: substr(raw_barcode, k, 1) <> substr(barcode, k, 1))) AS hd FROM (SELECT DISTINCT raw_barcode FROM p), w),
 b AS (SELECT * FROM m WHERE hd <= 1 QUALIFY hd = min(hd) OVER (PARTITION BY raw_barcode) AND count(*) OVER (PARTITION BY raw_barcode, hd) = 1)
 SELECT read_index, rx, raw_barcode, barcode, i AS "index", hd, rest1, rest2, CASE WHEN barcode IS NULL THEN 'barcode' END AS rr FROM p LEFT JOIN b USING (raw_barcode)""",
    "reads",
)
def demultiplex(spark, d):
    pairs = view(spark, d, "reads").select("read_index", F.concat("rx", F.lit("ACG"), "rx", F.lit("TT"), "contig").alias("r1"), F.concat("gn", "cigar").alias("r2"))
    known = barcodes.expanded(_whitelist(spark, d).withColumn("barcode", F.concat(F.lit("ACG"), "barcode", F.lit("TT"))), 1)
    return barcodes.demultiplexed(pairs, barcodes.LAYOUTS["scCHIC384C8U3"], known).select("read_index", "rx", "raw_barcode", "barcode", "index", "hd", "rest1", "rest2", "rr")


# -- calls ------------------------------------------------------------------------------------------------------------


def _bases(spark, d):
    return view(spark, d, "reads").select(
        "sm", "contig", (F.col("start_") % 300).alias("pos"), F.substring("rx", 1, 1).alias("base"), F.col("mapq").alias("qual"), F.substring("rx", 2, 1).alias("ref"), "is_read1", "is_reverse", "mapq",
        (F.col("read_index") % 10).alias("cycle"), F.substring("rx", 3, 1).alias("context"), (~F.col("is_read1")).alias("is_read2"),
    )


_BASES = "b AS (SELECT sm, contig, start_ % 300 AS pos, substr(rx, 1, 1) AS base, mapq AS qual, substr(rx, 2, 1) AS ref, is_read1, is_reverse, mapq, read_index % 10 AS cycle, substr(rx, 3, 1) AS context, NOT is_read1 AS is_read2 FROM reads)"


@q("best_of_mates", f"WITH {_BASES}, t AS (SELECT contig, pos, max(qual) AS qual FROM b GROUP BY ALL) SELECT contig, pos, CASE WHEN count(DISTINCT base) = 1 THEN min(base) ELSE 'N' END AS base, CASE WHEN count(DISTINCT base) = 1 THEN max(qual) ELSE 0 END AS qual FROM b JOIN t USING (contig, pos, qual) GROUP BY contig, pos", "reads")
def best_of_mates(spark, d):
    return calls.best_of_mates(_bases(spark, d), "contig", "pos")


@q("consensus", f"WITH {_BASES} SELECT sm, contig, pos, base, n FROM (SELECT sm, contig, pos, base, count(*) AS n FROM b GROUP BY ALL) QUALIFY n = max(n) OVER (PARTITION BY sm, contig, pos) AND count(*) OVER (PARTITION BY sm, contig, pos, n) = 1", "reads")
def consensus(spark, d):
    return calls.majority(_bases(spark, d), "sm", "contig", "pos")


@q(
    "likelihood_call",
    f"""WITH {_BASES}, s AS (SELECT contig, pos, base, round(sum(ln(greatest(least(1 - pow(10, -qual / 10.0), 1 - 1e-9), 1e-9) / 0.25)), 6) AS l FROM b GROUP BY ALL), m AS (SELECT contig, pos, max(l) AS log_likelihood FROM s GROUP BY ALL)
 SELECT contig, pos, CASE WHEN count(*) = 1 THEN min(base) ELSE 'N' END AS base, any_value(log_likelihood) AS log_likelihood FROM s JOIN m USING (contig, pos) WHERE l = log_likelihood GROUP BY contig, pos""",
    "reads",
)
def likelihood_call(spark, d):
    return calls.likelihood_call(_bases(spark, d), "contig", "pos").select("contig", "pos", "base", "log_likelihood")


@q("covariates", f"WITH {_BASES} SELECT qual, is_read2, CAST(floor(cycle / 3.0) AS BIGINT) AS cycle_bin, context, count(*) AS n, count(*) FILTER (base <> ref) AS errors, CAST(round_even(least(60, -10 * log10((count(*) FILTER (base <> ref) + 1.0) / (count(*) + 2.0))), 0) AS INT) AS observed_quality FROM b GROUP BY ALL", "reads")
def covariates(spark, d):
    return calls.covariates(_bases(spark, d), 3)


_CALLS = "c AS (SELECT sm, contig, start_ % 100 AS pos, CASE substr(rx, 1, 1) WHEN 'A' THEN 'z' WHEN 'C' THEN 'Z' WHEN 'G' THEN 'x' ELSE '.' END AS symbol FROM reads)"
_BETA = _CALLS + ", f AS (SELECT sm, contig, pos, count(*) FILTER (symbol = upper(symbol)) AS methylated, count(*) FILTER (symbol <> upper(symbol)) AS unmethylated, avg((symbol = upper(symbol))::int) AS beta FROM c WHERE symbol <> '.' GROUP BY ALL)"


def _calls(spark, d):
    b = F.substring("rx", 1, 1)
    return view(spark, d, "reads").select("sm", "contig", (F.col("start_") % 100).alias("pos"), F.when(b == "A", "z").when(b == "C", "Z").when(b == "G", "x").otherwise(".").alias("symbol"))


@q("methylation_betas", f"WITH {_BETA} SELECT * FROM f", "reads")
def methylation_betas(spark, d):
    return calls.beta_frame(_calls(spark, d), "sm", "contig", "pos")


@q("methylation_bulk", f"WITH {_BETA} SELECT contig, pos, sum(methylated) AS methylated, sum(unmethylated) AS unmethylated, round(sum(methylated) / (sum(methylated) + sum(unmethylated))::double, 9) AS beta, round(var_pop(beta), 9) AS beta_variance, count(*) AS n_samples FROM f GROUP BY contig, pos", "reads")
def methylation_bulk(spark, d):
    b = calls.bulk_frame(methylation_betas(spark, d), "contig", "pos")
    return b.withColumn("beta", F.round("beta", 9)).withColumn("beta_variance", F.round("beta_variance", 9))


@q("methylation_pruned", f"WITH {_BETA} SELECT f.* FROM f JOIN (SELECT contig, pos FROM f GROUP BY ALL HAVING count(*) >= 8 AND var_pop(beta) >= 0.05) USING (contig, pos)", "reads")
def methylation_pruned(spark, d):
    return calls.pruned(methylation_betas(spark, d), ["contig", "pos"], 8, 0.05)


@q("methylation_distances", f"WITH {_BETA} SELECT a.sm AS a, b.sm AS b, round(avg(abs(a.beta - b.beta)), 9) AS distance, count(*) AS loci FROM f a JOIN f b ON a.contig = b.contig AND a.pos = b.pos AND a.sm < b.sm GROUP BY a.sm, b.sm", "reads")
def methylation_distances(spark, d):
    return calls.sample_distances(methylation_betas(spark, d), "sm", ["contig", "pos"]).withColumn("distance", F.round("distance", 9))


@q("conversion_efficiency", f"WITH {_CALLS} SELECT sm, lower(symbol) AS context, round(avg((symbol = upper(symbol))::int), 9) AS rate, count(*) AS n FROM c WHERE symbol <> '.' GROUP BY ALL", "reads")
def conversion_efficiency(spark, d):
    return calls.conversion_efficiency(_calls(spark, d), "sm").withColumn("rate", F.round("rate", 9))


_GENO = """g AS (SELECT contig, start_ % 400 + 1 AS pos, 'A' AS ref, CASE WHEN (start_ % 400) % 3 = 0 THEN 'T' ELSE 'AC' END AS alt, ly AS sample, CASE nm WHEN 0 THEN '0/0' WHEN 1 THEN '1/1' WHEN 2 THEN './.' ELSE '0|1' END AS gt
 FROM (SELECT contig, start_, ly, min(nm) AS nm FROM reads GROUP BY contig, start_, ly))"""


@q(
    "informative_alleles",
    f"""WITH {_GENO}, a AS (SELECT contig, pos - 1 AS pos, sample, unnest(regexp_split_to_array(gt, '[/|]')) AS x, ref, alt FROM g WHERE length(alt) = 1),
 s AS (SELECT contig, pos, CASE WHEN x = '0' THEN ref ELSE alt END AS base, list_sort(list(DISTINCT sample)) AS samples FROM a WHERE x IN ('0', '1') GROUP BY contig, pos, base)
 SELECT contig, pos, base, array_to_string(samples, ',') AS samples FROM s QUALIFY count(*) OVER (PARTITION BY contig, pos) > 1""",
    "reads",
)
def informative_alleles(spark, d):
    g = view(spark, d, "reads").groupBy("contig", "start_", F.col("ly").alias("sample")).agg(F.min("nm").alias("nm"))
    p = F.col("start_") % 400
    g = g.select(
        "contig", (p + 1).alias("pos"), F.lit("A").alias("ref"), F.when(p % 3 == 0, "T").otherwise("AC").alias("alt"), "sample",
        F.when(F.col("nm") == 0, "0/0").when(F.col("nm") == 1, "1/1").when(F.col("nm") == 2, "./.").otherwise("0|1").alias("gt"),
    )
    return calls.informative_alleles(g).withColumn("samples", F.array_join("samples", ","))


@q(
    "gene_counts",
    """SELECT sm, gene, round(sum(w), 6) AS n FROM (SELECT sm, read_index, gene, 1.0 / count(*) OVER (PARTITION BY sm, read_index) AS w FROM (SELECT DISTINCT sm, read_index, gene FROM reads r JOIN features f ON r.contig = f.contig AND ds BETWEEN f_start AND f_end)) GROUP BY sm, gene""",
    "reads", "features",
)
def gene_counts(spark, d):
    # A gene's overlapping features are one interval; what is left of several hits of a gene is taken once.
    f = view(spark, d, "features").withColumn("_end", F.col("f_end") + 1)
    genes = windows.merged_ranges(f, "f_start", "_end", "contig", "gene").select("contig", "gene", F.col("start_").alias("f_start"), (F.col("end_") - 1).alias("f_end"))
    return calls.genes_by_place(view(spark, d, "reads"), genes, "sm").withColumn("n", F.round("n", 6))


@q(
    "splicing",
    """WITH h AS (SELECT DISTINCT read_index, gene, f_name, CASE WHEN CAST(substr(f_name, 2) AS INT) % 7 = 0 THEN 'intron' ELSE 'exon' END AS kind, f_strand AS transcript FROM reads r JOIN features f ON r.contig = f.contig AND greatest(start_, f_start) <= least(end_, f_end)),
 t AS (SELECT read_index, gene, transcript, count(DISTINCT f_name) FILTER (kind = 'exon') AS e, max((kind = 'intron')::int) AS i FROM h GROUP BY ALL),
 g AS (SELECT read_index, gene, max(e) >= 2 AND max(i) = 0 AS j FROM t GROUP BY ALL)
 SELECT read_index, string_agg(gene, ',' ORDER BY gene) AS genes, coalesce(string_agg(gene, ',' ORDER BY gene) FILTER (j), '') AS junctions, CASE WHEN bool_or(j) THEN 1.0 ELSE 0.5 END AS it FROM g GROUP BY read_index""",
    "reads", "features",
)
def splicing(spark, d):
    kind = F.when(F.substring("f_name", 2, 20).cast("int") % 7 == 0, "intron").otherwise("exon")
    f = view(spark, d, "features").withColumns({"kind": kind, "transcript": F.col("f_strand")})
    return calls.spliced_spans(view(spark, d, "reads"), f, "read_index")


@q(
    "introns",
    """SELECT contig, gene, reach + 1 AS intron_start, f_start - 1 AS intron_end FROM (SELECT *, max(f_end) OVER (PARTITION BY contig, gene ORDER BY f_start, f_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM features) WHERE reach IS NOT NULL AND f_start > reach + 1""",
    "features",
)
def introns(spark, d):
    return calls.introns(view(spark, d, "features"), "contig", "gene")


@q(
    "copy_number",
    """WITH n AS (SELECT sm, contig || ':' || CAST(floor(start_ / 20000.0) AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY ALL), k AS (SELECT n.* FROM n JOIN (SELECT sm FROM n GROUP BY sm HAVING sum(n) > 20) USING (sm)),
 b AS (SELECT k.* FROM k JOIN (SELECT bin FROM k GROUP BY bin HAVING quantile_cont(n, 0.5) <> 0) USING (bin)), s AS (SELECT sm, quantile_cont(n, 0.9) AS qq, quantile_cont(n, 0.5) AS m FROM b GROUP BY sm HAVING quantile_cont(n, 0.5) > 0)
 SELECT sm, bin, round(least(4.0, least(n, qq) * 2 / m), 6) AS copies FROM b JOIN s USING (sm)""",
    "reads",
)
def copy_number(spark, d):
    n = view(spark, d, "reads").groupBy("sm", F.concat("contig", F.lit(":"), F.floor(F.col("start_") / 20000.0).cast("string")).alias("bin")).agg(F.count("*").alias("n"))
    return calls.copy_number(n, "sm", 20, 4.0, 0.9).withColumn("copies", F.round("copies", 6))


# -- statistics -------------------------------------------------------------------------------------------------------


@q(
    "read_statistics",
    """SELECT is_read1, count(*) AS total, count(*) FILTER (NOT unmapped) AS mapped, count(*) FILTER (unmapped) AS unmapped, count(*) FILTER (NOT unmapped AND NOT qcfail) AS assigned,
 count(*) FILTER (NOT unmapped AND NOT qcfail AND NOT duplicate) AS deduplicated FROM reads GROUP BY is_read1""",
    "reads",
)
def read_statistics(spark, d):
    return statistics.read_counts(view(spark, d, "reads"))


@q("cell_statistics", "SELECT sm, count(*) AS reads, count(*) FILTER (NOT duplicate) AS umis FROM reads GROUP BY sm", "reads")
def cell_statistics(spark, d):
    return statistics.cell_counts(view(spark, d, "reads"))


@q("mapq_histogram", "SELECT mapq, count(*) AS n FROM reads GROUP BY mapq", "reads")
def mapq_histogram(spark, d):
    return statistics.histogram(view(spark, d, "reads"), "mapq")


@q(
    "library_cascade",
    """SELECT ly, contig, CASE WHEN unmapped THEN 'unmapped' WHEN qcfail THEN 'qcfail' WHEN duplicate THEN 'duplicate' WHEN proper AND is_read1 AND mapq + 10 >= 60 AND coalesce(nullif(nm, 3) <= 2, true) AND NOT regexp_matches(cigar, '[ISD]') THEN 'safe' ELSE 'pass' END AS kind, count(*) AS n FROM reads GROUP BY ALL""",
    "reads",
)
def library_cascade(spark, d):
    return statistics.cascade(view(spark, d, "reads").withColumns({"mapq": F.col("mapq") + 10, "nm": F.nullif(F.col("nm"), F.lit(3))}), "ly", "contig")


@q(
    "plate",
    """SELECT ly, CAST(floor((i - 1) / 12.0) AS INT) AS "row", CAST((i - 1) % 12 AS INT) AS col, count(*) AS total, count(*) FILTER (qcfail) AS qcfail, count(*) FILTER (NOT qcfail AND NOT duplicate) AS molecules FROM (SELECT *, CAST(split_part(sm, '_', 2) AS INT) AS i FROM reads) GROUP BY ALL""",
    "reads",
)
def plate(spark, d):
    return statistics.plate(view(spark, d, "reads"), F.split("sm", "_")[1].cast("int"), 12)


@q("ligation_ratio", "SELECT sm, avg((substr(rx, 1, 2) = 'TA')::int) AS ta, count(*) AS n FROM reads WHERE is_read1 AND NOT duplicate GROUP BY sm", "reads")
def ligation_ratio(spark, d):
    return statistics.start_ratio(view(spark, d, "reads"), F.substring("rx", 1, 2))


@q("conversion_matrix", f"WITH {_BASES} SELECT ref, base, is_read1, is_reverse, count(*) AS n FROM b WHERE mapq >= 30 GROUP BY ALL", "reads")
def conversion_matrix(spark, d):
    return statistics.conversions(_bases(spark, d))


@q(
    "lorenz",
    "SELECT v, sum(m) OVER w / sum(m) OVER () AS rank, sum(v * m) OVER w / sum(v * m) OVER () AS share FROM (SELECT v, count(*)::double AS m FROM (SELECT ds, count(*) AS v FROM reads GROUP BY ds) GROUP BY v) WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)",
    "reads",
)
def lorenz(spark, d):
    return statistics.lorenz(view(spark, d, "reads"), "ds")


@q("mapping_rate", "SELECT ly, avg((NOT unmapped)::int) AS rate FROM reads GROUP BY ly", "reads")
def mapping_rate(spark, d):
    return statistics.mapping_rate(view(spark, d, "reads"), "ly")


@q("oversequencing", "SELECT fragments, count(*) AS n FROM (SELECT count(*) AS fragments FROM reads GROUP BY sm, contig, start_ % 200, rx) GROUP BY fragments", "reads")
def oversequencing(spark, d):
    m = _sites(spark, d).groupBy("sm", "contig", "site", "rx").agg(F.count("*").alias("fragments"))
    return statistics.oversequencing(m)


@q("counter_moments", "SELECT sm, round(avg(mapq), 9) AS mean, round(stddev_pop(mapq), 6) AS deviation FROM reads GROUP BY sm", "reads")
def counter_moments(spark, d):
    n = view(spark, d, "reads").groupBy("sm", "mapq").agg(F.count("*").alias("n"))
    return statistics.moments(n, "mapq", "n", "sm").select("sm", F.round("mean", 9).alias("mean"), F.round("deviation", 6).alias("deviation"))


@q(
    "mutual_information",
    "WITH n AS (SELECT contig, nm, count(*)::double AS n FROM reads GROUP BY ALL) SELECT round(sum(n / t * ln(n * t / (a * b))), 9) AS mi FROM (SELECT n, sum(n) OVER (PARTITION BY contig) AS a, sum(n) OVER (PARTITION BY nm) AS b, sum(n) OVER () AS t FROM n)",
    "reads",
)
def mutual_information(spark, d):
    return statistics.mutual_information(view(spark, d, "reads"), "contig", "nm").select(F.round("mi", 9).alias("mi"))


@q(
    "downsample",
    """WITH n AS (SELECT sm, contig, count(*) AS n FROM reads GROUP BY ALL), o AS (SELECT sm, contig, unnest(generate_series(1, n)) AS k FROM n)
 SELECT sm, contig, count(*) AS n FROM (SELECT sm, contig FROM o QUALIFY row_number() OVER (PARTITION BY sm ORDER BY md5(sm || ':' || contig || ':' || k || ':1')) <= 100) GROUP BY sm, contig""",
    "reads",
)
def downsample(spark, d):
    n = view(spark, d, "reads").groupBy("sm", "contig").agg(F.count("*").alias("n"))
    return statistics.downsampled(n, "sm", "contig", 100)
