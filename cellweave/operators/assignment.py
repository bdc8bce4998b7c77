"""Which fragments count as equal, protocol by protocol, and the registry of methods.

A rule names the columns that must agree, and how position and UMI are compared. Rules without tolerance run as plain
groups; the others go through molecules.assign. A method adds to its rule what prepares fragments and what makes a
molecule valid, all as Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.operators import molecules


@dataclass(frozen=True)
class Rule:
    """key: columns that agree; position and end: what lies within radius (none: anywhere); umi: within hamming (none: any)."""

    key: tuple[str, ...]
    position: str | None = "start_"
    end: str | None = "end_"
    umi: str | None = "rx"
    radius: int = 0
    hamming: int = 0
    pooling: int = 1


# Radii and distances of the protocols.
GENERIC = Rule(("sm", "contig", "is_reverse"))
CHIC = Rule(("sm", "contig", "is_reverse"), "site", None, hamming=1)
NLA = Rule(("sm", "contig", "is_reverse", "site"), None, None, hamming=1)
NLA_ALLELE = Rule(("sm", "contig", "is_reverse", "site", "allele"), None, None, hamming=1)
GENE = Rule(("is_reverse", "xt", "sm"), None, None, hamming=1)
GENE_FULL_LENGTH = Rule(("is_reverse", "xt", "sm"), "start_", "end_", "rx", 10_000, 1)
NO_UMI = Rule(("sm", "contig", "is_reverse"), "start_", "end_", None)
SCAR = Rule(("sm", "contig", "is_reverse"), "start_", "end_", None, 0, 0)


def with_molecules(fragments: DataFrame, rule: Rule, most: int | None = None) -> DataFrame:
    """Fragments (with read_index) and their molecule (its first read_index), rc and overflow.

    Rows with a null key belong to no molecule and are left out. Rules without tolerance are groups of equal keys, UMIs
    and positions; the others are greedy, in the order of read_index."""
    rows = fragments
    for k in rule.key:
        rows = rows.where(F.col(k).isNotNull())
    if rule.radius == 0 and rule.hamming == 0 and rule.position != "start_" and most is None:
        key = [*rule.key, *([rule.position] if rule.position else []), *([rule.umi] if rule.umi else [])]
        w = Window.partitionBy(*key)
        return rows.withColumns({"molecule": F.min("read_index").over(w), "rc": F.row_number().over(w.orderBy("read_index")) - 1, "overflow": F.lit(False)})
    placed = rows if rule.position else rows.withColumn("_zero", F.lit(0))
    found = molecules.assign(placed, list(rule.key), rule.position or "_zero", rule.umi, rule.radius, rule.hamming, rule.pooling, most, rule.end)
    return fragments.join(found, "read_index")


def transcripts(fragments: DataFrame, hamming: int = 0) -> DataFrame:
    """(read_index, molecule): fragments of a cell, contig and strand that share a gene, directly or by way of others, and a UMI
    (within hamming of the first of their molecule). genes is an array; fragments without a gene belong to none."""
    each = fragments.where(F.size("genes") > 0).select("read_index", "sm", "contig", "is_reverse", "rx", F.explode("genes").alias("gene"))
    found = molecules.assign(each.select(F.col("read_index"), "sm", "contig", "is_reverse", "gene", "rx", F.lit(0).alias("_zero")), ["sm", "contig", "is_reverse", "gene"], "_zero", "rx", 0, hamming)
    # a fragment of several genes joins the earliest molecule of any
    return found.groupBy("read_index").agg(F.min("molecule").alias("molecule"))


def by_allele(fragments: DataFrame, molecule: str = "molecule", allele: str = "allele") -> DataFrame:
    """Molecules split by the alleles of their fragments: molecule becomes the first fragment of the allele, cr tells of a split."""
    alleles = fragments.groupBy(F.col(molecule).alias("_m")).agg(F.count_distinct(F.coalesce(allele, F.lit(""))).alias("_n"))
    w = Window.partitionBy(molecule, allele)
    out = fragments.join(alleles, F.col(molecule) == F.col("_m"))
    return out.withColumns({"molecule": F.min("read_index").over(w), "cr": F.when(F.col("_n") > 1, "SplitUponAlleleClustering")}).drop("_m", "_n")


def reactions(fragments: DataFrame, molecule: str = "molecule", contig: str = "primer_contig", start: str = "primer_start", primer: str = "primer", most_n: int = 0) -> DataFrame:
    """(read_index, molecule, reaction): fragments by the random primer that they began with.

    A primer with at most most_n unknown bases (N) joins every reaction of its molecule and place whose known primer it
    fits; one that fits none, or has more of them, belongs to no reaction. A null primer is a reaction of its own."""
    rows = fragments.select("read_index", F.col(molecule).alias("molecule"), F.col(contig).alias("contig"), F.col(start).alias("start"), F.col(primer).alias("primer"))
    unknown = F.length(F.regexp_replace("primer", "[^N]", ""))
    plain = rows.where(F.col("primer").isNull() | (unknown == 0))
    named = plain.select("molecule", F.when(F.col("primer").isNotNull(), F.col("contig")).alias("contig"), F.when(F.col("primer").isNotNull(), F.col("start")).alias("start"), "primer").distinct()
    direct = plain.select("read_index", "molecule", F.when(F.col("primer").isNull(), "none").otherwise(F.concat_ws(":", F.coalesce("contig", F.lit("")), F.coalesce(F.col("start").cast("string"), F.lit("")), "primer")).alias("reaction"))
    k = named.where("primer is not null").select(F.col("molecule").alias("_m"), F.col("contig").alias("_c"), F.col("start").alias("_s"), F.col("primer").alias("_p"))
    loose = rows.where((unknown > 0) & (unknown <= most_n))
    on = (F.col("molecule") == F.col("_m")) & F.col("contig").eqNullSafe(F.col("_c")) & F.col("start").eqNullSafe(F.col("_s")) & (F.length("primer") == F.length("_p"))
    fits = F.size(F.filter(F.arrays_zip(F.split("primer", "").alias("a"), F.split("_p", "").alias("b")), lambda x: (x["a"] != "N") & (x["a"] != x["b"]))) == 0
    rescued = loose.join(k, on).where(fits).select("read_index", "molecule", F.concat_ws(":", F.coalesce("_c", F.lit("")), F.coalesce(F.col("_s").cast("string"), F.lit("")), "_p").alias("reaction"))
    return direct.unionByName(rescued)


def merged(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members (read_index, molecule) after the molecules b of pairs (a, b) have been added to a; pairs do not chain."""
    into = pairs.select(F.col("b").alias("_b"), F.col("a").alias("_a")).distinct()
    return members.join(into, F.col("molecule") == F.col("_b"), "left").withColumn("molecule", F.coalesce("_a", "molecule")).drop("_a", "_b")


def site_duplicates(reads: DataFrame, *key: str) -> DataFrame:
    """Reads with rc, from 1, in the order of read_index among those of one key (cell, site and UMI), and duplicate from 2 on."""
    rc = F.row_number().over(Window.partitionBy(*key).orderBy("read_index"))
    return reads.withColumns({"rc": rc, "duplicate": rc > 1})


@dataclass(frozen=True)
class Method:
    """A tagging method: its rule (none: transcripts, by shared genes), what adds the columns the rule needs, which molecules are
    valid, and its unit of work."""

    rule: Rule | None
    prepare: Callable[[DataFrame], DataFrame] = lambda fragments: fragments
    valid: Callable[[], Column] = lambda: F.lit(True)
    tile: int = 5_000_000


def _consensus_site() -> Column:
    return F.col("consensus_site").isNotNull()


def _only_valid(fragments: DataFrame) -> DataFrame:
    return fragments.where(F.coalesce(F.col("valid"), F.lit(True))) if "valid" in fragments.columns else fragments


# The names by which users know the methods, and the bases that a task of each takes.
METHODS: dict[str, Method] = {
    "qflag": Method(Rule(("read_index",), None, None, None), tile=3_000_000),
    "chic": Method(CHIC, valid=_consensus_site),
    "chic_nla": Method(CHIC, valid=_consensus_site),
    "chict": Method(CHIC, valid=_consensus_site, tile=100_000_000),
    "chic_taps": Method(CHIC, valid=_consensus_site),
    "chic_taps_transcriptome": Method(CHIC, valid=_consensus_site),
    "nla": Method(NLA, _only_valid, _consensus_site, 10_000_000),
    "nla_no_overhang": Method(NLA, _only_valid, _consensus_site, 10_000_000),
    "nla_taps": Method(NLA, _only_valid, _consensus_site),
    "nla_transcriptome": Method(NLA, _only_valid, _consensus_site),
    "nla_taps_transcriptome": Method(NLA, _only_valid, _consensus_site),
    "nla_tapsp_transcriptome": Method(NLA, _only_valid, _consensus_site),
    "cs": Method(None),
    "vasa": Method(None),
    "cs_feature_counts": Method(GENE),
    "fl_feature_counts": Method(GENE_FULL_LENGTH),
    "episeq": Method(GENE),
    "scartrace": Method(SCAR),
}


def tagged(fragments: DataFrame, method: str, most: int | None = None) -> DataFrame:
    """Fragments of a method by name with molecule, rc, af (fragments of the molecule) and duplicate; an unknown name is an error."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {', '.join(sorted(METHODS))}")
    m = METHODS[method]
    rows = m.prepare(fragments)
    if m.rule is None:
        rc = F.row_number().over(Window.partitionBy("molecule").orderBy("read_index")) - 1
        found = rows.join(transcripts(rows), "read_index").withColumn("rc", rc)
    else:
        found = with_molecules(rows, m.rule, most)
    return found.withColumns({"af": F.count("*").over(Window.partitionBy("molecule")), "duplicate": F.col("rc") > 0})
