"""Annotation joins: mappability, aligned blocks and bases, names of genes, UTRs, gene counts, groups of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators import intervals


def with_mappability(rows: DataFrame, safe: DataFrame, *key: str) -> DataFrame:
    """Rows with mp: 'unique' where the site (key) is listed as 'ok', 'bad' where it is listed as anything else, null where it is
    not listed. The list (key, state) is joined on the site, never held on the driver."""
    s = safe.select(*[F.col(k).alias(f"_{k}") for k in key], "state").dropDuplicates([f"_{k}" for k in key])
    on = F.lit(True)
    for k in key:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(s, on, "left").withColumn("mp", F.when(F.col("state") == "ok", "unique").when(F.col("state").isNotNull(), "bad")).drop("state", *[f"_{k}" for k in key])


def _blocks() -> Column:
    """The stretches (s, e) of a read that a CIGAR aligns without a gap, half-open and in order."""
    n, op = F.regexp_extract_all("cigar", F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), F.regexp_extract_all("cigar", F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))

    def step(t: Column, s: Column) -> Column:
        size, kind = s["n"].cast("long"), s["op"]
        after = t["r"] + F.when(kind.isin("M", "D", "N", "=", "X"), size).otherwise(F.lit(0).cast("long"))
        return F.struct(after.alias("r"), F.when(kind.isin("M", "=", "X"), F.concat(t["blocks"], F.array(F.struct(t["r"].alias("s"), after.alias("e"))))).otherwise(t["blocks"]).alias("blocks"))

    begin = F.struct(F.col("start_").cast("long").alias("r"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("blocks"))
    return F.aggregate(F.arrays_zip(n.alias("n"), op.alias("op")), begin, step, lambda t: t["blocks"])


def aligned_blocks(reads: DataFrame, *keep: str) -> DataFrame:
    """(keep, contig, block, b_start, b_end): the stretches of a read that a CIGAR aligns without a gap, half-open."""
    names = [k for k in keep if k != "contig"]
    return reads.where("cigar is not null").select(*names, "contig", F.posexplode(_blocks()).alias("block", "_b")).select(*names, "contig", "block", F.col("_b.s").alias("b_start"), F.col("_b.e").alias("b_end"))


def features_of_blocks(reads: DataFrame, features: DataFrame, *keep: str) -> DataFrame:
    """(keep, f_name) once for every feature that an aligned block of a read overlaps (closed ends); gaps do not count.

    A pair is taken at the first block that meets the feature, so pairs are not moved to be told apart. Only those of reads that share
    their keep, or of features that share their name, are."""
    names = [k for k in keep if k != "contig"]
    reads, features = reads.where("cigar is not null").select(*names, "contig", "start_", "cigar"), features.select("contig", "f_start", "f_end", "f_name")

    def met(r: DataFrame, f: DataFrame) -> DataFrame:
        blocks = F.filter(_blocks(), lambda b: b["s"] < b["e"])
        r = r.select(*names, "contig", blocks.alias("_bs")).select(*names, "contig", "_bs", F.posexplode("_bs").alias("_i", "_b"))
        r = r.select(*names, "contig", F.col("_b.s").alias("b_start"), (F.col("_b.e") - 1).alias("_last"), F.when(F.col("_i") > 0, F.get("_bs", F.col("_i") - 1)["e"] - 1).alias("_before"))
        return intervals.overlaps(r, f, "b_start", "_last").where("_before is null or f_start > _before").select(*keep, "f_name")

    one, shared = intervals.by_sharing(reads, *keep) if keep else (None, reads)
    alone, namesakes = intervals.by_sharing(features, "f_name")
    again = [met(r, f) for r, f in ((shared, features), (one, namesakes)) if r is not None and f is not None]
    out = [] if one is None else [met(one, alone)]
    if again:
        out.append((again[0].union(again[1]) if len(again) > 1 else again[0]).distinct())
    return out[0].union(out[1]) if len(out) > 1 else out[0]


def features_of_bases(reads: DataFrame, features: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, f_name): the features at each aligned base."""
    bases = aligned_blocks(reads, *keep).where("b_start < b_end").select(*keep, *([] if "contig" in keep else ["contig"]), F.explode(F.sequence("b_start", F.col("b_end") - 1)).alias("pos"))
    return intervals.points_in(bases, features, "pos").select(*keep, "pos", "f_name")


def bases_of_features(reads: DataFrame, features: DataFrame, *by: str) -> DataFrame:
    """(by, f_name, n): how many aligned bases each feature holds, as features_of_bases counted by feature, without its rows."""
    return intervals.covered_bases(aligned_blocks(reads, *by), features, list(by), ["f_name"]).select(*by, "f_name", "n")


def spanning(reads: DataFrame, *by: str) -> DataFrame:
    """(by, contig, span_start, span_end, positions, covered): the span of all reads of a key, its distinct aligned positions, and the
    aligned bases in all."""
    blocks = aligned_blocks(reads, *by)
    names = [k for k in by if k != "contig"]
    ends = blocks.groupBy(*names, "contig").agg(F.min("b_start").alias("span_start"), F.max("b_end").alias("span_end"), F.sum(F.col("b_end") - F.col("b_start")).alias("covered"))
    each = blocks.where("b_start < b_end").select(*names, "contig", F.explode(F.sequence("b_start", F.col("b_end") - 1)).alias("pos")).distinct()
    return ends.join(each.groupBy(*names, "contig").agg(F.count("*").alias("positions")), [*names, "contig"])


def coverage_at(reads: DataFrame, contig: str, pos: int, dedup: bool = True, passed: bool = True) -> DataFrame:
    """(sm, n): reads that align a base at one position; gaps and skips do not count."""
    # What a read aligns is told by its CIGAR alone; end_ may lie before its last base.
    rows = reads.where((F.col("contig") == contig) & (F.col("start_") <= pos))
    if dedup:
        rows = rows.where(~F.col("duplicate"))
    if passed:
        rows = rows.where(~F.col("qcfail"))
    return aligned_blocks(rows, "sm", "read_index").where(F.lit(pos).between(F.col("b_start"), F.col("b_end") - 1)).groupBy("sm").agg(F.count_distinct("read_index").alias("n"))


def gene_names(features: DataFrame) -> DataFrame:
    """(gene_id, gene_name) of features with a map of attributes; without a name the id stands for it."""
    a = F.col("attributes")
    rows = features.where(a["gene_id"].isNotNull()).select(a["gene_id"].alias("gene_id"), F.coalesce(a["gene_name"], a["Name"], a["gene_id"]).alias("gene_name"))
    return rows.groupBy("gene_id").agg(F.min("gene_name").alias("gene_name"))


def converted(rows: DataFrame, column: str, names: DataFrame, old: str, new: str) -> DataFrame:
    """Rows whose identifiers in column are replaced where names knows them, by an equality join."""
    n = names.select(F.col(old).alias("_old"), F.col(new).alias("_new")).dropDuplicates(["_old"])
    return rows.join(n, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def with_utrs(features: DataFrame, kinds: tuple[str, ...] = ("three_prime_utr", "five_prime_utr")) -> DataFrame:
    """Exons (contig, f_start, f_end, f_strand, f_name, kind) with is_<kind> of each kind of UTR: one of it on the exon's strand
    begins within the exon."""
    out = features.where("kind = 'exon'")
    for kind in kinds:
        starts = features.where(F.col("kind") == kind).select("contig", F.col("f_start").alias("_at"), F.col("f_strand").alias("_s")).distinct()
        hit = intervals.points_in(starts, features.where("kind = 'exon'"), "_at").where("_s = f_strand").select("contig", "f_start", "f_end", "f_strand", "f_name").distinct()
        hit = hit.withColumn(f"is_{kind}", F.lit(True))
        out = out.join(hit, ["contig", "f_start", "f_end", "f_strand", "f_name"], "left").withColumn(f"is_{kind}", F.coalesce(f"is_{kind}", F.lit(False)))
    return out


def transcript_counts(molecules: DataFrame, *sample: str, allele: str | None = None) -> DataFrame:
    """(sample, kind, feature, n): every molecule counts one over its genes for each of its genes, exons, introns and junctions (four
    arrays); with allele a feature's name begins with it, 'noAllele' where it is null."""
    share = 1.0 / F.nullif(F.size("genes"), F.lit(0))
    kinds = ("genes", "exons", "introns", "junctions")
    def entries(k: str) -> Column:
        return F.transform(F.coalesce(F.col(k), F.array().cast("array<string>")), lambda x: F.struct(F.lit(k[:-1]).alias("kind"), x.alias("f")))

    each = F.flatten(F.array(*[entries(k) for k in kinds]))
    rows = molecules.where(F.size("genes") > 0).select(*sample, share.alias("_w"), *([F.coalesce(allele, F.lit("noAllele")).alias("_a")] if allele else []), F.explode(each).alias("_f"))
    name = F.concat_ws("_", "_a", "_f.f") if allele else F.col("_f.f")
    return rows.groupBy(*sample, F.col("_f.kind").alias("kind"), name.alias("feature")).agg(F.sum("_w").alias("n"))


def grouped_cells(rows: DataFrame, groups: DataFrame, sample: str = "sm") -> DataFrame:
    """Rows with the group of their cell (groups: sm, group; a cell may have several); cells without one are left out."""
    g = groups.select(F.col("sm").alias("_sm"), "group").distinct()
    return rows.join(g, F.col(sample) == F.col("_sm")).drop("_sm")


def chromosome_order(contig: Column) -> list[Column]:
    """Sort keys by which chr2 comes before chr10, and X, Y and MT after the numbers."""
    name = F.regexp_replace(contig, "(?i)^chr", "")
    number = F.when(name.rlike(r"^\d+$"), name.cast("int"))
    special = F.when(F.upper(name) == "X", 1001).when(F.upper(name) == "Y", 1002).when(F.upper(name).isin("M", "MT"), 1003)
    return [F.coalesce(number, special, F.lit(1004)), name]


def concatenated(*matrices: DataFrame) -> DataFrame:
    """Matrices below one another; a column that one lacks is null there."""
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


def prefix_sums(table: DataFrame, column: str, value: str, *by: str) -> DataFrame:
    """Sums over the part of column before its first underscore."""
    return table.groupBy(*by, F.substring_index(column, "_", 1).alias("prefix")).agg(F.sum(value).alias("n"))


def mark_of(library: Column) -> Column:
    """The histone mark that a library's name tells, the first that fits, or NA."""
    name, out = F.lower(library), F.lit("NA")
    for mark in reversed(("K9me3", "K4me1", "K4me3", "K27me3", "K36me3")):
        out = F.when(name.contains(mark.lower()), f"H3{mark}").otherwise(out)
    return out


def oversequenced_cells(copies: DataFrame, above: int = 100) -> DataFrame:
    """(sm, copies, seen) of cells with more than above reads, from counts (sm, copies, molecules) of all bins."""
    n = copies.groupBy("sm", "copies").agg(F.sum("molecules").alias("seen"))
    enough = n.groupBy(F.col("sm").alias("_sm")).agg(F.sum(F.col("copies") * F.col("seen")).alias("_r")).where(F.col("_r") > above)
    return n.join(enough, F.col("sm") == F.col("_sm"), "left_semi")


def nucleosome_molecules(molecules: DataFrame, min_mapq: float = 55, most: int = 800) -> DataFrame:
    """(sm, contig, span_start, length): molecules that match wholly, are mapped well on average and are no longer than most, with
    two bases added to their length."""
    size = F.col("span_end") - F.col("span_start")
    keep = F.col("complete") & (F.col("mean_mapq") >= min_mapq) & (size <= most)
    return molecules.where(keep).select("sm", "contig", "span_start", (size + 2).alias("length"))


def reads_in_files(lines: DataFrame) -> DataFrame:
    """(file, reads): a quarter of the lines of each FASTQ file."""
    return lines.groupBy("file").agg(F.floor(F.count("*") / 4).alias("reads"))


def composed(records: DataFrame, sequence: list[Column], quality: list[Column]) -> DataFrame:
    """Records with sequence and quality put together from tags; lengths that differ are an error, nulls count as empty."""
    s, q = (F.concat(*[F.coalesce(x, F.lit("")) for x in xs]) for xs in (sequence, quality))
    same = F.when(F.length(s) == F.length(q), q).otherwise(F.raise_error(F.lit("sequence and quality differ in length")).cast("string"))
    return records.withColumns({"sequence": s, "quality": same})
