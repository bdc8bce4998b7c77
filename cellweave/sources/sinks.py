"""Writers: matrices, tracks, FASTQ, VCF and tables by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.write.mode("overwrite").option("header", True).csv(path)


def write_bedgraph(bins: DataFrame, contigs: DataFrame, path: str, value: str = "n") -> None:
    """contig, start, end, value lines; a bin's end is clipped to the contig."""
    lengths = contigs.select(F.col("contig").alias("_c"), "length_")
    rows = bins.join(lengths, F.col("contig") == F.col("_c")).withColumn("bin_end", F.least("bin_end", F.col("length_") - 1))
    rows.sort("contig", "bin_start").select(F.concat_ws("\t", "contig", "bin_start", "bin_end", value).alias("value")).write.mode("overwrite").text(path)


def write_methylation_bed(frame: DataFrame, path: str) -> None:
    """BED lines with a score of at most 1000 and a colour from blue to red by beta."""
    red = F.rint(F.col("beta") * 255).cast("int").cast("string")
    blue = F.rint((1 - F.col("beta")) * 255).cast("int").cast("string")
    n = F.least(F.lit(1000), F.col("methylated") + F.col("unmethylated"))
    line = F.concat_ws("\t", "contig", "pos", F.col("pos") + 1, F.lit("."), n, F.lit("+"), "pos", F.col("pos") + 1, F.concat_ws(",", red, F.lit("0"), blue))
    frame.sort("contig", "pos").select(line.alias("value")).write.mode("overwrite").text(path)


def write_fastq(records: DataFrame, path: str, by: str | None = None) -> None:
    """FASTQ text of (header, sequence, plus, qual), in a folder for each value of by."""
    text = F.concat_ws("\n", F.concat(F.lit("@"), "header"), "sequence", "plus", "qual").alias("value")
    if by:
        records.select(text, by).repartition(by).write.mode("overwrite").partitionBy(by).text(path)
    else:
        records.select(text).write.mode("overwrite").text(path)


def write_split(df: DataFrame, path: str, by: str) -> None:
    """One folder for each value of a tag."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_sorted(reads: DataFrame, path: str, partitions: int | None = None) -> None:
    """Coordinate-sorted Parquet: ranges of (contig, start_), sorted within."""
    n = partitions or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reads.repartitionByRange(n, "contig", "start_").sortWithinPartitions("contig", "start_").write.mode("overwrite").parquet(path)


def write_vcf(variants: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", "contig", "pos", F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."))
    variants.sort("contig", "pos").select(line.alias("value")).write.mode("overwrite").text(path)


def tabulated(reads: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen fields and tags; what is neither a column nor a tag reads 'None'."""
    pick = lambda c: F.col(c).cast("string") if c in reads.columns else F.col("tags")[c] if "tags" in reads.columns else F.lit(None)
    return reads.select(*[F.coalesce(pick(c), F.lit("None")).alias(c) for c in columns])


def write_introns(introns: DataFrame, path: str, identifier: str = "gene_id") -> None:
    """GTF lines of introns (contig, strand, an identifier, intron_start, intron_end), positions as in the exons' file (K16)."""
    attributes = F.concat(F.lit(f'{identifier} "'), identifier, F.lit('";'))
    line = F.concat_ws("\t", "contig", F.lit("."), F.lit("intron"), "intron_start", "intron_end", F.lit("."), "strand", F.lit("."), attributes)
    introns.sort("contig", "intron_start", "intron_end").select(line.alias("value")).write.mode("overwrite").text(path)


def merged(*frames: DataFrame) -> DataFrame:
    """All rows of several inputs (K3); columns that one of them lacks are null there."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
