"""Fragments: mates of one read name, their strand, span and cut site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import sequence as S

_FIELDS = ["read_index", "contig", "start_", "end_", "is_reverse", "mapq", "cigar", "sm", "rx"]


def pair(reads: DataFrame) -> DataFrame:
    """One row a read name: r1 and r2 as structs, null where a mate is missing; the first read of several stands."""
    row = F.struct(*_FIELDS)
    one = lambda first: F.min(F.when(F.col("is_read1") == first, row))
    return reads.groupBy("query_name").agg(one(F.lit(True)).alias("r1"), one(F.lit(False)).alias("r2"))


def strand(r1: Column, r2: Column) -> Column:
    """Whether the fragment is reverse: as its first read, else against its second."""
    return F.coalesce(r1["is_reverse"], ~r2["is_reverse"])


def fragments(pairs: DataFrame) -> DataFrame:
    """Sample, UMI, strand, span, whether the span is safe, and the site of each pair."""
    r1, r2 = F.col("r1"), F.col("r2")
    both = r1.isNotNull() & r2.isNotNull() & (r1["contig"] == r2["contig"])
    inward = both & (r1["is_reverse"] != r2["is_reverse"])
    same = both & ~inward
    low = F.when(same, F.least(r1["start_"], r2["start_"])).otherwise(F.least(r1["start_"], r2["start_"]))
    high = F.when(same, F.greatest(r1["start_"], r2["start_"])).otherwise(F.greatest(r1["end_"], r2["end_"]))
    one = F.coalesce(r1, r2)
    return pairs.select(
        "query_name", F.coalesce(r1["sm"], r2["sm"]).alias("sm"), F.coalesce(r2["rx"], r1["rx"]).alias("rx"), one["contig"].alias("contig"), strand(r1, r2).alias("is_reverse"),
        F.greatest(r1["mapq"], r2["mapq"]).alias("mapq"), F.when(both, low).otherwise(one["start_"]).alias("start_"), F.when(both, high).otherwise(one["end_"]).alias("end_"),
        (inward | ~both).alias("safe"), chic_site(one).alias("site"), one["read_index"].alias("read_index"), (r1.isNotNull() & r2.isNotNull()).alias("paired"),
    )


def chic_site(read: Column) -> Column:
    """Cut site of a blunt-cut read: two before a forward start, one after a reverse end, corrected for soft clips."""
    forward = read["start_"] - 2 - S.leading_clip(read["cigar"])
    return F.when(read["is_reverse"], read["end_"] + 1 + S.trailing_clip(read["cigar"])).otherwise(forward)


def nla_site(seq: Column, start: Column, end: Column, reverse: Column, cigar: Column) -> Column:
    """Cut site of a read that must begin with CATG (end with it when reverse); null where it does not."""
    return F.when(reverse & seq.endswith("CATG"), end - 4 + S.trailing_clip(cigar)).when(~reverse & seq.startswith("CATG"), start - S.leading_clip(cigar))


def umi_of_bases(seq: Column, at: int, length: int) -> Column:
    return F.substring(seq, at + 1, length)


def sample_name(library: Column, index: Column) -> Column:
    return F.concat_ws("_", library, F.coalesce(index.cast("string"), F.lit("BULK")))


def read_group(flowcell: Column, lane: Column, sample: Column) -> Column:
    return F.concat_ws(".", F.coalesce(flowcell, F.lit("NONE")), F.coalesce(lane, F.lit("NONE")), sample)
