"""Libraries of sequence files, groups of cells, call tables, tag names of other tools, masks and filters of matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How other tools name the barcode and the molecule's code.
TAG_DIALECTS = {"cellranger": {"BC": "CB", "RX": "UB"}, "dropseq": {"BC": "XC", "RX": "XM"}}


def discovered(files: DataFrame, replace: tuple[tuple[str, str], ...] = (), one_library: str | None = None, merge: tuple[str, int] | None = None, single: bool = False) -> DataFrame:
    """S18. (path, library, lane, mate, complete) of sequence files by their names.

    Names end in R1 or R2 with or without an underscore, are SRR accessions with a mate's number, or carry lane, mate and
    part (_L001_R1_001); a name that ends in .filt loses its last part first. replace are literal (old, new) pairs for the
    library's name; one_library puts accessions and lanes under one name, with the old name as lane; merge (delimiter, n)
    joins the first n parts of a lane's library. complete: the lane has both mates with equally many files (always where
    single). Null paths are left out; a path that comes twice counts twice."""
    name = F.substring_index("path", "/", -1)
    for ending in (".fastq", ".gz", ".fq"):
        name = F.replace(name, F.lit(ending), F.lit(""))
    rows = files.where("path is not null").select("path", F.when(name.endswith(".filt"), F.regexp_replace(name, "_[^_]*$", "")).otherwise(name).alias("_n"))
    n = F.col("_n")
    spaced, plain, accession = n.rlike("_R[12]$"), n.rlike("R[12]$"), n.startswith("SRR")
    of_lane = F.regexp_replace(n, "_L[0-9]{3}_R[12]_[0-9]{3}", "")

    def renamed(c: Column) -> Column:
        for old, new in replace:
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    run = renamed(F.substring_index(n, "_", 1))
    lane = F.regexp_replace(n, "_R[12]_[0-9]{3}", "")
    group = F.lit(one_library) if one_library else renamed(of_lane)
    if merge:
        group = F.array_join(F.slice(F.split(group, rf"\Q{merge[0]}\E"), 1, merge[1]), "")
    alone = F.lit("single_file")
    rows = rows.select(
        "path",
        F.when(spaced, renamed(F.regexp_replace(n, "_R[12]$", ""))).when(plain, renamed(F.regexp_replace(n, "R[12]$", ""))).when(accession, F.lit(one_library) if one_library else run).otherwise(group).alias("library"),
        F.when(spaced | plain, alone).when(accession, run if one_library else alone).otherwise(lane).alias("lane"),
        F.when(spaced | plain, F.right(n, F.lit(2))).when(accession, F.concat(F.lit("R"), F.substring_index(n, "_", -1))).otherwise(F.regexp_replace(F.replace(n, F.concat(lane, F.lit("_")), F.lit("")), "_[0-9]{3}", "")).alias("mate"),
    )
    per_mate = rows.groupBy("library", "lane", "mate").agg(F.count("*").alias("_files"))
    per_lane = per_mate.groupBy("library", "lane").agg((F.lit(single) & (F.min("_files") == F.max("_files")) | (F.count("*") == 2) & (F.min("_files") == F.max("_files"))).alias("complete"))
    return rows.join(per_lane, ["library", "lane"]).select("path", "library", "lane", "mate", "complete")


def in_dialect(reads: DataFrame, tool: str, tags: str = "tags") -> DataFrame:
    """K13. Reads whose map of tags has barcode and molecule code under the tool's names too, in place of what stood there; absent
    tags add nothing."""
    entries, new = F.map_entries(tags), TAG_DIALECTS[tool]
    for source, name in new.items():
        value, held = F.col(tags)[source], F.lit(name)
        added = F.concat(F.filter(entries, lambda e: e["key"] != held), F.array(F.struct(held.alias("key"), value.alias("value"))))  # noqa: B023
        entries = F.when(value.isNotNull(), added).otherwise(entries)
    return reads.withColumn(tags, F.map_from_entries(entries))


def pseudobulks(reads: DataFrame, groups: DataFrame, cell: str = "sm") -> DataFrame:
    """K9. Reads that are no duplicates, of cells that have a group, with it; groups is (cell, cluster). A cell's last
    line counts in a file of groups, so a cell with two clusters is an error here."""
    one = groups.where("cell is not null").groupBy("cell").agg(F.min("cluster").alias("cluster"), F.count_distinct("cluster").alias("_n"))
    one = one.select(F.col("cell").alias("_cell"), F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two clusters: "), "cell"))).otherwise(F.col("cluster")).alias("cluster"))
    return reads.where(~F.col("duplicate")).join(one, F.col(cell) == F.col("_cell")).drop("_cell")


def call_lines(calls: DataFrame, form: str = "table", separator: str = ":", contexts: list[str] | None = None) -> DataFrame:
    """K12. One line of text for each methylation call (sample, molecule, site, length, umi, strand, contig, pos from 0, symbol,
    motif; for table_more also qual and cov), as table, table_more or bed. Bases without a context and contexts that are not
    asked for are left out; nulls read None."""
    rows = calls.where("symbol <> '.'")
    if contexts is not None:
        rows = rows.where(F.col("symbol").isin(contexts))
    text = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("None"))
    name = F.concat_ws(separator, *[text(c) for c in ("sample", "molecule", "site", "length", "umi", "strand")])
    if form == "bed":
        fields = [text("contig"), text("pos"), text(F.col("pos") + 1), F.substring_index(text("sample"), "_", -1), F.lit("1"), text("strand")]
    else:
        more = [text("qual"), text("cov")] if form == "table_more" else []
        fields = [name, text("contig"), text(F.col("pos") + 1), text("symbol"), *more, text("motif")]
    return rows.select(F.concat_ws("\t", *fields).alias("value"))


def of_datatype(records: DataFrame, datatype: str, header: str = "header") -> DataFrame:
    """F24. Records whose header holds dt: and the type; pairs go by the first mate's header."""
    return records.where(F.col(header).contains(f"dt:{datatype}"))


def measured(values: DataFrame, least: int = 0, variance: float = 0.0, by: tuple[str, ...] = ("contig", "bin_start")) -> DataFrame:
    """F27. The rows (cell, by, value) of the places with more than least values of zero or more, and a sample variance of at least
    variance; a limit of 0 keeps all. A place with one value has no variance and is dropped where one is asked for."""
    if least <= 0 and variance <= 0:
        return values
    place = values.groupBy(*by).agg(F.count_if(F.col("value") >= 0).alias("_n"), F.var_samp("value").alias("_v"))
    keep = place.where((F.col("_n") > least if least > 0 else F.lit(True)) & (F.coalesce(F.col("_v") >= variance, F.lit(False)) if variance > 0 else F.lit(True)))
    return values.join(keep.select(*by), list(by), "left_semi")


def tag_counts(reads: DataFrame, tags: str = "tags") -> DataFrame:
    """A14. (tag, n): the tags that reads have, whatever their values."""
    return reads.select(F.explode(F.map_keys(tags)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def in_report(reads: DataFrame, report: DataFrame, group: str = "rg") -> DataFrame:
    """R22. Reads whose read group a recalibration report knows (report: read_group)."""
    return reads.join(report.select(F.col("read_group").alias("_rg")), F.col(group) == F.col("_rg"), "left_semi")


def masked(chunks: DataFrame, variants: DataFrame) -> DataFrame:
    """K18. The chunks (contig, chunk_start, seq) of a reference with N at each variant of one base (contig, pos from 0, ref, alt; a
    null alt is none). Variants outside the reference change nothing. Chunks of one width, as the reader makes them; a whole contig is one chunk."""
    width = chunks.agg(F.max(F.length("seq")).alias("w")).first().w or 1
    single = variants.where("length(ref) = 1 and (alt is null or length(alt) = 1) and pos >= 0").select(F.col("contig").alias("_c"), (F.floor(F.col("pos") / F.lit(width)) * width).alias("_s"), "pos").distinct()
    sites = single.groupBy("_c", "_s").agg(F.sort_array(F.collect_list((F.col("pos") - F.col("_s")).cast("int"))).alias("_p"))  # at most one place a base of the chunk
    joined = chunks.join(sites, (F.col("contig") == F.col("_c")) & (F.col("chunk_start") == F.col("_s")), "left")
    inside = F.filter(F.coalesce("_p", F.array().cast("array<int>")), lambda p: p < F.length("seq"))
    ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), inside).alias("a"), F.concat(inside, F.array(F.length("seq"))).alias("b"))
    pieces = F.transform(ends, lambda e: F.substr("seq", e["a"] + 2, e["b"] - e["a"] - 1))
    return joined.select("contig", "chunk_start", F.array_join(pieces, "N").alias("seq"))


def chromosome_number(contig: Column) -> Column:
    """R63. The number of 7 or chr7, -1 for every other name."""
    return F.coalesce(F.replace(contig, F.lit("chr"), F.lit("")).try_cast("int"), F.lit(-1))


def positions_of(*variants: DataFrame) -> DataFrame:
    """U4. The distinct (contig, pos) of several tables of variants."""
    out = variants[0].select("contig", "pos")
    for v in variants[1:]:
        out = out.unionByName(v.select("contig", "pos"))
    return out.distinct()


def common_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """U3. The distinct hits that both have, nulls equal to nulls."""
    return a.intersect(b.select(*a.columns))
