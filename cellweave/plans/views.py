"""Genomic views over the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DIV = "CAST(floor({} / CAST({} AS DOUBLE)) AS BIGINT)"


def _base(shift: int) -> str:
    return f"substr('ACGT', CAST({_DIV.format('l_orderkey % 64', shift)} % 4 + 1 AS INT), 1)"


READS = f"""
SELECT l_orderkey * 10 + l_linenumber AS read_index,
  CAST(l_orderkey AS VARCHAR(20)) || '_' || CAST({_DIV.format('(l_linenumber - 1)', 2)} AS VARCHAR(20)) AS query_name,
  'chr' || CAST(l_suppkey % 5 + 1 AS VARCHAR(20)) AS contig,
  (l_partkey * 37 + l_linenumber * 11) % 100000 AS start_,
  (l_partkey * 37 + l_linenumber * 11) % 100000 + 20 + l_linenumber * 5 AS end_,
  (l_orderkey + l_linenumber) % 2 = 1 AS is_reverse, l_linenumber % 2 = 1 AS is_read1, l_linenumber % 2 = 0 AND l_linenumber <> 6 AS is_read2, CAST(l_linenumber * 17 % 61 AS INT) AS mapq,
  'LIB' || CAST(l_suppkey % 3 AS VARCHAR(20)) || '_' || CAST(l_orderkey % 24 + 1 AS VARCHAR(20)) AS sm, 'LIB' || CAST(l_suppkey % 3 AS VARCHAR(20)) AS ly,
  {_base(16)} || {_base(4)} || {_base(1)} AS rx,
  CAST(l_linenumber % 4 AS INT) AS nm, CAST(1 + l_linenumber % 3 AS INT) AS nh,
  'G' || CAST(l_partkey % 50 AS VARCHAR(20)) || ',G' || CAST(l_suppkey % 50 AS VARCHAR(20)) AS gn,
  l_returnflag = 'R' AND l_linenumber = 7 AS qcfail, l_linestatus = 'F' AND l_linenumber % 5 = 0 AS duplicate,
  CASE WHEN l_partkey % 11 = 0 THEN 'bad' WHEN l_partkey % 13 = 0 THEN NULL ELSE 'unique' END AS mp,
  CASE WHEN l_linenumber % 6 = 0 THEN '20M2I10M' WHEN l_linenumber % 6 = 1 THEN '5S30M' WHEN l_linenumber % 6 = 2 THEN '30M4S' ELSE '40M' END AS cigar,
  CASE WHEN l_partkey % 7 = 0 THEN 'chr1,+100,40M,1;' WHEN l_partkey % 7 = 1 THEN 'chr2_alt,-5,40M,0;chr9_alt,+7,40M,2;' ELSE NULL END AS xa,
  CASE WHEN (l_orderkey + l_linenumber) % 2 = 1 THEN (l_partkey * 37 + l_linenumber * 11) % 100000 + 20 + l_linenumber * 5 ELSE (l_partkey * 37 + l_linenumber * 11) % 100000 END AS ds,
  CAST(l_quantity AS DOUBLE) AS value_, l_orderkey % 9 = 0 AS unmapped, l_linenumber % 7 <> 6 AS proper
FROM lineitem
"""

FEATURES = """
SELECT 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR(20)) AS contig, (p_partkey * 53) % 100000 AS f_start, (p_partkey * 53) % 100000 + p_size * 10 AS f_end,
  CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS f_strand, 'F' || CAST(p_partkey AS VARCHAR(20)) AS f_name, 'GENE' || CAST(p_partkey % 40 AS VARCHAR(20)) AS gene
FROM part
"""

CONTIGS = "SELECT 'chr' || CAST(r_regionkey + 1 AS VARCHAR(20)) AS contig, CAST(100000 AS BIGINT) AS length_ FROM region"

BLACKLIST = """
SELECT 'chr' || CAST(s_suppkey % 5 + 1 AS VARCHAR(20)) AS contig, (s_suppkey * 977) % 100000 AS b_start, (s_suppkey * 977) % 100000 + 150 AS b_end FROM supplier
"""

_LENGTH = "CASE cigar WHEN '20M2I10M' THEN 32 WHEN '5S30M' THEN 35 WHEN '30M4S' THEN 34 ELSE 40 END"

#: Reads with sequences and qualities.
SEQUENCED = f"""
SELECT *, substr(repeat('ACGTTGCACCGGTA', 5), CAST(1 + read_index % 14 AS INT), {_LENGTH}) AS seq, substr(repeat('IIFF5#:B', 8), CAST(1 + read_index % 8 AS INT), {_LENGTH}) AS qual
FROM ({READS}) AS r
"""

GENOME = """
SELECT 'chr' || CAST(r_regionkey + 1 AS VARCHAR(20)) AS contig, substr(repeat('CGATTCAGCCGTACCTGAA', 6000), CAST(1 + r_regionkey AS INT), 100000) AS seq FROM region
"""

VARIANTS = """
SELECT 'S' || CAST(p_partkey % 7 AS VARCHAR(20)) AS sample, 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR(20)) AS contig, (p_partkey * 53) % 100000 AS pos,
  substr('ACGT', CAST(1 + p_size % 4 AS INT), 1) AS ref, substr('CGTA', CAST(1 + p_partkey % 4 AS INT), 1) AS alt,
  substr('GATTACACCGTA', CAST(1 + p_partkey % 10 AS INT), 1) || substr('ACGT', CAST(1 + p_size % 4 AS INT), 1) || substr('TGCATTGC', CAST(1 + p_size % 8 AS INT), 1) AS around
FROM part
"""

VIEWS = {"sequenced": SEQUENCED, "genome": GENOME, "variants": VARIANTS, "reads": READS, "features": FEATURES, "contigs": CONTIGS, "blacklist": BLACKLIST}
_TABLES = {"sequenced": "lineitem", "genome": "region", "variants": "part", "reads": "lineitem", "features": "part", "contigs": "region", "blacklist": "supplier"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = _TABLES[name]
    return spark.sql(VIEWS[name].replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def sql(body: str, *names: str) -> str:
    """DuckDB SQL of body with the named views before it."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
