"""Read predicates, composable as Columns. Columns follow the alignment schema: mapq, cigar, nm, xa, mp and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import sequence as S
from cellweave.operators import intervals



def has_hits_elsewhere(xa: Column) -> Column:
    """Whether XA lists a hit on a contig that is no _alt."""
    hits = F.filter(F.split(F.coalesce(xa, F.lit("")), ";"), lambda x: x != "")
    return F.exists(hits, lambda x: ~F.substring_index(x, ",", 1).endswith("_alt"))


def counted(
    r1_only: bool = False, r2_only: bool = False, mappable: bool = False, min_mapq: int = 0, proper: bool = False, no_indels: bool = False, max_edits: int | None = None,
    no_clips: bool = False, no_alternative: bool = False, dedup: bool = False, qcfail: bool = False, mapped: bool = True,
) -> Column:
    """The composed filter of the count table, each part as its option says. r1_only drops second mates and r2_only first ones,
    so that reads without a mate pass both."""
    parts = [F.lit(True)]
    if r1_only:
        parts.append(~F.col("is_read2"))
    if r2_only:
        parts.append(~F.col("is_read1"))
    if mappable:
        parts.append(F.coalesce(F.col("mp") == "unique", F.lit(False)))
    if not qcfail:
        parts.append(~F.col("qcfail"))
    if min_mapq:
        parts.append(F.col("mapq") >= min_mapq)
    if proper:
        parts.append(F.col("proper"))
    if no_indels:
        parts.append(~F.col("cigar").rlike("[ID]"))
    if max_edits is not None:
        parts.append(F.col("nm").isNull() | (F.col("nm") <= max_edits))
    if no_clips:
        parts.append(~F.col("cigar").contains("S"))
    if no_alternative:
        parts.append(~has_hits_elsewhere(F.col("xa")))
    if mapped:
        parts.append(~F.col("unmapped"))
    if dedup:
        parts.append(~F.col("duplicate"))
    return reduce(lambda a, b: a & b, parts)


def binned_filter(min_mapq: int, dedup: bool = True, r1_only: bool = False) -> Column:
    """As for binned counts: a missing mp passes."""
    out = (F.col("mapq") >= min_mapq) & ~F.col("qcfail") & (F.col("mp").isNull() | (F.col("mp") == "unique"))
    if dedup:
        out &= ~F.col("duplicate")
    return out & F.col("is_read1") if r1_only else out


def cut_filter(kind: str) -> Column:
    """default, strict or loose read filters of the cut analyses."""
    loose = F.col("is_read1") & ~F.col("qcfail")
    if kind == "loose":
        return loose
    if kind == "default":
        return loose & ~F.col("duplicate") & (F.col("mapq") >= 30)
    return loose & ~F.col("duplicate") & (F.col("mapq") >= 50) & ~F.col("cigar").rlike("[SI]") & F.col("proper") & (F.col("nm") <= 1)


def soft_clip_filter(limit: float) -> Column:
    return S.soft_clip_ratio(F.col("cigar")) < limit


def expression(df: DataFrame, text: str) -> DataFrame:
    """Keep the rows for which a SQL expression holds."""
    return df.where(F.expr(text))


def without_blacklisted(reads: DataFrame, blacklist: DataFrame, bin_size: int | None = None) -> DataFrame:
    """Drop reads that start or end within a region (half-open); those that span one stay."""
    return intervals.outside(reads, blacklist, "contig", ("start_", "end_"), "b_start", "b_end", bin_size)


def pairs_on_contigs(pairs: DataFrame, skip: list[str]) -> DataFrame:
    """Drop pairs all of whose mates lie on skipped contigs."""
    here = lambda c: c.isNull() | c.isin(skip)
    return pairs.where(~(here(F.col("contig1")) & here(F.col("contig2"))))


def main_contigs(contig: Column) -> Column:
    return ~contig.rlike(r"(?i)random|_alt|^KN|^KZ|^JH|^chrUn|decoy|^EBV")
