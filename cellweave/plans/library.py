"""Queries of sequence files, cell groups, call tables, tag names, masks and filters, with the SQL of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import bases as B
from cellweave.operators import library as L
from cellweave.plans.registry import query
from cellweave.plans.variation import _CALLS, _symbols, q
from cellweave.plans.views import view

_FILES = """f AS (SELECT CAST(floor(c_custkey / 10.0) AS BIGINT) AS k, c_custkey % 5 AS kind, CASE WHEN c_custkey % 10 < 5 THEN '1' ELSE '2' END AS m, CASE WHEN c_custkey % 20 < 10 THEN '1' ELSE '2' END AS part
 FROM {customer} WHERE c_custkey % 37 <> 0),
 p AS (SELECT *, '/run/' || CASE kind WHEN 0 THEN 'lib-' || CAST(k AS VARCHAR(20)) || '_R' || m || '.fastq.gz' WHEN 1 THEN 'plate' || CAST(k AS VARCHAR(20)) || 'R' || m || '.fq.gz' WHEN 2 THEN 'SRR' || CAST(k AS VARCHAR(20)) || '_' || m || '.fastq'
  WHEN 3 THEN 'cells-x-' || CAST(k AS VARCHAR(20)) || '_L00' || part || '_R' || m || '_001.fastq.gz' ELSE 'Org_' || CAST(k AS VARCHAR(20)) || '_L001_R' || m || '_00' || part || '_BHG.filt.fastq.gz' END AS path FROM f)"""


@query(
    "library_discovery",
    f"""WITH {_FILES.format(customer='customer')}, n AS (SELECT path, 'R' || m AS mate, CASE kind WHEN 0 THEN 'lib-' || k WHEN 1 THEN 'p' || k WHEN 2 THEN 'SRR' || k WHEN 3 THEN 'cellsx' ELSE 'Org_' || k END AS library,
  CASE kind WHEN 3 THEN 'cells-x-' || k || '_L00' || part WHEN 4 THEN 'Org_' || k || '_L001' ELSE 'single_file' END AS lane FROM p),
 t AS (SELECT library, lane, count(*) FILTER (mate = 'R1') AS a, count(*) FILTER (mate = 'R2') AS b FROM n GROUP BY library, lane)
 SELECT path, n.library, n.lane, mate, a = b AS complete FROM n JOIN t ON n.library = t.library AND n.lane = t.lane""",
)
def library_discovery(spark, d):
    files = spark.sql(f"WITH {_FILES.format(customer='{t}')} SELECT path FROM p", t=spark.read.parquet(f"{d}/customer.parquet"))
    return L.discovered(files, replace=(("plate", "p"),), merge=("-", 2))


@q("tag_dialect", "SELECT read_index, ly AS bc, CASE WHEN nm = 0 THEN 'own' ELSE ly END AS cb, rx AS ub FROM (SELECT * REPLACE (CASE WHEN nm = 0 THEN NULL ELSE ly END AS ly) FROM reads)", "reads")
def tag_dialect(spark, d):
    tags = F.map_filter(F.create_map(F.lit("BC"), F.when(F.col("nm") != 0, F.col("ly")), F.lit("RX"), F.col("rx"), F.lit("CB"), F.lit("own")), lambda _, v: v.isNotNull())
    out = L.in_dialect(view(spark, d, "reads").withColumn("tags", tags), "cellranger")
    return out.select("read_index", F.col("tags")["BC"].alias("bc"), F.col("tags")["CB"].alias("cb"), F.col("tags")["UB"].alias("ub"))


@q("pseudobulk_reads", "SELECT read_index, sm, 'cluster' || right(sm, 1) AS cluster FROM reads WHERE NOT duplicate AND right(sm, 1) IN ('1', '2', '3', '4')", "reads")
def pseudobulk_reads(spark, d):
    r = view(spark, d, "reads")
    groups = r.select(F.col("sm").alias("cell"), F.concat(F.lit("cluster"), F.right("sm", F.lit(1))).alias("cluster")).where("right(cell, 1) in ('1', '2', '3', '4')").distinct()
    return L.pseudobulks(r, groups).select("read_index", "sm", "cluster")


@q(
    "call_lines",
    f"""WITH {_CALLS} SELECT concat_ws(chr(9), concat_ws(':', sm, read_index, coalesce(ds::VARCHAR, 'None'), end_ - start_, rx, CASE WHEN is_reverse THEN '-' ELSE '+' END), contig, (pos + 1)::BIGINT, symbol, coalesce(mp, 'None')) AS value
 FROM symbols WHERE symbol IN ('Z', 'z')""",
    "sequenced", "genome",
)
def call_lines(spark, d):
    calls = B.called_bases(_symbols(spark, d, "read_index", "sm", "ds", "start_", "end_", "rx", "mp"), "zZ", "read_index", "sm", "ds", "start_", "end_", "rx", "mp")
    strand = F.when(F.col("is_reverse"), "-").otherwise("+")
    return L.call_lines(calls.withColumns({"sample": F.col("sm"), "molecule": F.col("read_index"), "site": F.col("ds"), "length": F.col("end_") - F.col("start_"), "umi": F.col("rx"), "strand": strand, "motif": F.col("mp")}), contexts=["Z", "z"])


@q("datatype_records", "SELECT read_index, query_name || ';dt:' || ly || ';RX:' || rx AS header FROM reads WHERE ly = 'LIB1'", "reads")
def datatype_records(spark, d):
    r = view(spark, d, "reads").select("read_index", F.concat("query_name", F.lit(";dt:"), "ly", F.lit(";RX:"), "rx").alias("header"))
    return L.of_datatype(r, "LIB1")


_PLACES = "v AS (SELECT sm AS cell, contig, CAST(floor(start_ / 5000.0) AS BIGINT) AS bin_start, count(*) AS value FROM reads GROUP BY ALL)"


def _places(spark, d):
    return view(spark, d, "reads").groupBy(F.col("sm").alias("cell"), "contig", F.floor(F.col("start_") / 5000.0).alias("bin_start")).agg(F.count("*").alias("value"))


@q(
    "measured_places",
    f"WITH {_PLACES}, k AS (SELECT contig, bin_start FROM v GROUP BY contig, bin_start HAVING count(*) > 8 AND var_samp(value) >= 0.3) SELECT v.* FROM v SEMI JOIN k ON v.contig = k.contig AND v.bin_start = k.bin_start",
    "reads",
)
def measured_places(spark, d):
    return L.measured(_places(spark, d), 8, 0.3)


@q("tag_counts", "SELECT 'MP' AS tag, count(mp) AS n FROM reads UNION ALL SELECT 'XA', count(xa) FROM reads UNION ALL SELECT 'GN', count(gn) FROM reads", "reads")
def tag_counts(spark, d):
    tags = F.map_filter(F.create_map(F.lit("MP"), F.col("mp"), F.lit("XA"), F.col("xa"), F.lit("GN"), F.col("gn")), lambda _, v: v.isNotNull())
    return L.tag_counts(view(spark, d, "reads").select(tags.alias("tags")))


@q("report_read_groups", "SELECT read_index, ly || '.' || nh AS rg FROM reads WHERE ly <> 'LIB2' AND nh <> 3", "reads")
def report_read_groups(spark, d):
    r = view(spark, d, "reads").select("read_index", F.concat("ly", F.lit("."), "nh").alias("rg"))
    report = spark.createDataFrame([(f"LIB{a}.{b}",) for a in (0, 1) for b in (1, 2)], "read_group string")
    return L.in_report(r, report)


@q(
    "masked_reference",
    """WITH b AS (SELECT contig, i, substr(seq, CAST(i + 1 AS INT), 1) AS base FROM genome, range(100000) t(i)), n AS (SELECT DISTINCT contig, pos FROM variants)
 SELECT b.contig, CAST(floor(i / 10000.0) AS BIGINT) * 10000 AS chunk_start, string_agg(CASE WHEN pos IS NULL THEN base ELSE 'N' END, '' ORDER BY i) AS seq FROM b LEFT JOIN n ON n.contig = b.contig AND n.pos = i GROUP BY ALL""",
    "genome", "variants",
)
def masked_reference(spark, d):
    chunks = view(spark, d, "genome").select("contig", "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(90000).cast("long"), F.lit(10000).cast("long"))).alias("chunk_start"))
    chunks = chunks.select("contig", "chunk_start", F.substr("seq", (F.col("chunk_start") + 1).cast("int"), F.lit(10000)).alias("seq"))
    return L.masked(chunks, view(spark, d, "variants"))


@q("chromosome_numbers", "SELECT read_index, CAST(substr(contig, 4) AS INT) AS number, -1 AS other FROM reads", "reads")
def chromosome_numbers(spark, d):
    return view(spark, d, "reads").select("read_index", L.chromosome_number(F.col("contig")).alias("number"), L.chromosome_number(F.col("ly")).alias("other"))


@q("variant_positions", "SELECT DISTINCT contig, pos FROM variants WHERE sample IN ('S1', 'S2', 'S3')", "variants")
def variant_positions(spark, d):
    v = view(spark, d, "variants")
    return L.positions_of(*[v.where(F.col("sample") == s) for s in ("S1", "S2", "S3")])


@q("common_hits", "SELECT contig, f_strand, gene FROM features WHERE f_start < 8000 INTERSECT SELECT contig, f_strand, gene FROM features WHERE f_end >= 3000", "features")
def common_hits(spark, d):
    f = view(spark, d, "features")
    return L.common_hits(f.where("f_start < 8000").select("contig", "f_strand", "gene"), f.where("f_end >= 3000").select("gene", "contig", "f_strand"))
