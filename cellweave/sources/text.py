"""Readers of line formats as DataFrames; gzip is read by its extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _lines(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    df = spark.read.text(path)
    return df.where(~F.col("value").startswith(comment) & (F.trim("value") != "")) if comment else df


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, header, sequence, plus, qual). A file is one row, cut by the pattern of a whole record, so that a quality
    line that begins with @ does no harm; large runs come as many files."""
    raw = spark.read.text(path, wholetext=True)
    found = F.regexp_extract_all("value", F.lit(r"(@[^\n]+\n[^\n]*\n\+[^\n]*\n[^\n]*)(?:\n|$)"), F.lit(1))
    rows = raw.select(F.input_file_name().alias("file"), F.posexplode(found).alias("record", "r"))
    part = F.split("r", "\n")
    return rows.select("file", F.col("record").cast("long"), F.substr(part[0], F.lit(2)).alias("header"), part[1].alias("sequence"), part[2].alias("plus"), part[3].alias("qual"))


def fastq_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Mates by their place in the two files."""
    a = fastq(spark, first).select("record", "header", F.col("sequence").alias("r1"), F.col("qual").alias("q1"))
    b = fastq(spark, second).select("record", F.col("sequence").alias("r2"), F.col("qual").alias("q2"))
    return a.join(b, "record")


_FLAGS = {"is_paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "is_reverse": 16, "is_read1": 64, "is_read2": 128, "secondary": 256, "qcfail": 512, "duplicate": 1024, "supplementary": 2048}


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text: fixed fields, flags, 0-based half-open start_ and end_, and the tags as a map."""
    c = F.split("value", "\t")
    rows = _lines(spark, path, "@").select(c.alias("c"))
    n = lambda i: F.col("c")[i]
    flag = n(1).cast("int")
    span = F.aggregate(F.regexp_extract_all(n(5), F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0), lambda t, x: t + x.cast("int"))
    tags = F.map_from_entries(F.transform(F.slice("c", 12, 10_000), lambda t: F.struct(F.substring(t, 1, 2), F.substr(t, F.lit(6)))))
    return rows.select(
        n(0).alias("query_name"), flag.alias("flag"), F.nullif(n(2), F.lit("*")).alias("contig"), (n(3).cast("long") - 1).alias("start_"), (n(3).cast("long") - 1 + span).alias("end_"), n(4).cast("int").alias("mapq"),
        n(5).alias("cigar"), n(6).alias("mate_contig"), (n(7).cast("long") - 1).alias("mate_start"), n(8).cast("long").alias("isize"), n(9).alias("seq"), n(10).alias("qual"),
        *[(flag.bitwiseAND(bit) != 0).alias(k) for k, bit in _FLAGS.items()], tags.alias("tags"),
    )


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, fields): the header lines."""
    h = spark.read.text(path).where(F.col("value").rlike("^@[A-Z]{2}\t"))
    return h.select(F.substring("value", 2, 2).alias("kind"), F.str_to_map(F.regexp_replace(F.substr("value", F.lit(5)), "([A-Z]{2}):", "$1\u0001"), F.lit("\t"), F.lit("\u0001")).alias("fields"))


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    h = sam_header(spark, path).where("kind = 'SQ'")
    return h.select(F.col("fields")["SN"].alias("contig"), F.col("fields")["LN"].cast("long").alias("length_"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, f_start, f_end, f_name, f_strand) of BED lines of two to twelve columns; the blocks of twelve become rows."""
    c = F.split(F.trim("value"), r"[\t ]+")
    rows = _lines(spark, path).where(~F.col("value").rlike("^(track|browser)")).select(c.alias("c"))
    n = lambda i: F.get("c", F.lit(i))
    whole = rows.select(n(0).alias("contig"), n(1).cast("long").alias("f_start"), F.coalesce(n(2).cast("long"), n(1).cast("long") + 1).alias("f_end"), n(3).alias("f_name"), n(5).alias("f_strand"), F.when(F.size("c") >= 12, F.arrays_zip(F.split(n(10), ",").alias("size"), F.split(n(11), ",").alias("at"))).alias("b"))
    blocks = whole.withColumn("x", F.explode_outer(F.filter("b", lambda x: x["size"] != "")))
    at = F.col("f_start") + F.col("x.at").cast("long")
    return blocks.select("contig", F.coalesce(at, F.col("f_start")).alias("f_start"), F.coalesce(at + F.col("x.size").cast("long"), F.col("f_end")).alias("f_end"), "f_name", "f_strand")


def gtf(spark: SparkSession, path: str, kinds: list[str] | None = None, identifier: tuple[str, ...] = ("gene_id",), contigs: list[str] | None = None) -> DataFrame:
    """(contig, f_start, f_end, f_strand, kind, attributes, f_name) of GTF or GFF3 lines; both ends move by -1, and f_name joins
    the identifier's attributes by commas."""
    c = F.split("value", "\t")
    rows = _lines(spark, path).select(c.alias("c"))
    if kinds:
        rows = rows.where(F.col("c")[2].isin(kinds))
    if contigs:
        rows = rows.where(F.col("c")[0].isin(contigs))
    pair = F.filter(F.transform(F.split(F.col("c")[8], ";"), lambda x: F.trim(x)), lambda x: x != "")
    entry = lambda x: F.struct(F.regexp_extract(x, r"^([^\s=]+)", 1), F.regexp_replace(F.regexp_replace(x, r"^[^\s=]+[\s=]+", ""), '"', ""))
    attributes = F.map_from_entries(F.array_distinct(F.transform(pair, entry)))
    out = rows.select(F.col("c")[0].alias("contig"), (F.col("c")[3].cast("long") - 1).alias("f_start"), (F.col("c")[4].cast("long") - 1).alias("f_end"), F.col("c")[6].alias("f_strand"), F.col("c")[2].alias("kind"), attributes.alias("attributes"))
    return out.withColumn("f_name", F.concat_ws(",", *[F.col("attributes")[k] for k in identifier]))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(contig, pos from 1, ref, alt, sample, gt): one row for each sample and alternative of each record."""
    lines = spark.read.text(path)
    names = lines.where(F.col("value").startswith("#CHROM")).select(F.slice(F.split("value", "\t"), 10, 100_000).alias("s")).first()
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(c.alias("c"))
    if names is None:
        raise ValueError(f"{path} has no #CHROM line")
    samples = F.array(*[F.lit(x) for x in names.s])
    each = rows.select("c", F.explode(F.arrays_zip(samples.alias("sample"), F.slice("c", 10, 100_000).alias("call"))).alias("x"))
    gt = F.substring_index(F.col("x.call"), ":", 1)
    return each.select(F.col("c")[0].alias("contig"), F.col("c")[1].cast("long").alias("pos"), F.col("c")[3].alias("ref"), F.explode(F.split(F.col("c")[4], ",")).alias("alt"), F.col("x.sample").alias("sample"), gt.alias("gt"))


def variant_columns(spark: SparkSession, path: str, contig: str | None = None) -> DataFrame:
    """(contig, pos from 0, base, allele) of plain lines of contig, position from 1, id, ref and alt: two rows a line, the
    reference's base as REF and the other as ALT. Lines of other than five fields are an error."""
    c = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).select(F.when(F.size(c) == 5, c).otherwise(F.raise_error(F.concat(F.lit("not five fields: "), "value"))).alias("c"))
    if contig is not None:
        rows = rows.where(F.col("c")[0] == contig)
    both = F.array(F.struct(F.col("c")[3].alias("base"), F.lit("REF").alias("allele")), F.struct(F.col("c")[4].alias("base"), F.lit("ALT").alias("allele")))
    return rows.select(F.col("c")[0].alias("contig"), (F.col("c")[1].cast("long") - 1).alias("pos"), F.inline(both)).distinct()


def bed_bins(spark: SparkSession, path: str, contig: str | None = None) -> DataFrame:
    """(contig, bin_start, bin_end) of the first three columns of every line of a BED file."""
    c = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).select(c[0].alias("contig"), c[1].cast("long").alias("bin_start"), c[2].cast("long").alias("bin_end"))
    return rows if contig is None else rows.where(F.col("contig") == contig)


def used_contigs(reads: DataFrame) -> DataFrame:
    """(contig): the contigs that have reads."""
    return reads.where("contig is not null").select("contig").distinct()


def count_matrix(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(feature, cell, n) of a matrix with a header of cells and features in its first column; empty cells give no rows."""
    wide = spark.read.option("header", True).option("sep", separator).csv(path)
    first, *cells = wide.columns
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    each = F.array(*[F.struct(F.lit(c).alias("cell"), F.col(quoted(c)).cast("double").alias("n")) for c in cells])
    return wide.select(F.col(quoted(first)).alias("feature"), F.inline(each)).where("n is not null")


def fasta(spark: SparkSession, path: str, width: int = 1 << 20) -> DataFrame:
    """(contig, chunk_start, seq): the reference in chunks of width, so that a position finds its base by an equality join."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    contig = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")
    full = rows.select(contig.alias("contig"), F.upper(seq).alias("s"))
    n = F.ceil(F.length("s") / F.lit(float(width))).cast("int")
    return full.select("contig", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("k"), "s").select("contig", (F.col("k").cast("long") * width).alias("chunk_start"), F.substr("s", F.col("k") * width + 1, F.lit(width)).alias("seq"))


def barcode_file(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, index): one column (numbered in order from 1), or two in either order; the barcode is the one of bases."""
    c = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).select(c.alias("c"), F.monotonically_increasing_id().alias("_i"))
    bases = lambda x: x.rlike("^[ATCGNX]+$")
    one, two = F.col("c")[0], F.get("c", F.lit(1))
    nth = F.row_number().over(Window.orderBy("_i"))  # a whitelist is a few thousand lines
    return rows.select(F.when(bases(one), one).otherwise(two).alias("barcode"), F.coalesce(F.when(bases(one), two).otherwise(one), nth.cast("string")).alias("index"))


def methylation_table(spark: SparkSession, path: str) -> DataFrame:
    """(sample, contig, pos, symbol) of a tab-separated call file whose second field is sample:library:..."""
    c = F.split("value", "\t")
    return _lines(spark, path).select(F.substring_index(c[0], ":", 1).alias("sample"), c[1].alias("contig"), c[2].cast("long").alias("pos"), c[3].alias("symbol"))


def illumina_header(header: Column) -> dict[str, Column]:
    """Instrument, run, flowcell, lane, tile, x, y, mate, filter and index of a sequencer's header."""
    left, right = F.split(F.substring_index(header, " ", 1), ":"), F.split(F.substring_index(header, " ", -1), ":")
    names = ("Is", "RN", "Fc", "La", "Ti", "CX", "CY")
    return {k: F.get(left, F.lit(i)) for i, k in enumerate(names)} | {"Re": F.get(right, F.lit(0)), "Fi": F.get(right, F.lit(1)), "aA": F.get(right, F.lit(3))}
