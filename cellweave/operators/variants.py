"""Alleles and variants seen in molecules, mutation spectra and the mappability of digested sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import sequence as S


def detected_alleles(calls: DataFrame, min_cells: int = 3, *by: str) -> DataFrame:
    """(contig, pos, base, cells) of the bases that enough cells have; calls are molecules' (sm, contig, pos, base).

    N and null are no bases. Cells are counted after one row a cell is left, so a deep cell is not a hot group. by names a column that
    a position decides and that calls are dealt out by already."""
    seen = calls.where("base <> 'N'").select(*by, "contig", "pos", "base", "sm").distinct()
    return seen.groupBy(*by, "contig", "pos", "base").agg(F.count("sm").alias("cells")).where(F.col("cells") >= min_cells).drop(*by)


def variant_support(bases: DataFrame, variants: DataFrame, min_reads: int = 2) -> DataFrame:
    """(contig, pos, ref, alt, n_ref, n_alt, depth, supported) of every variant; without reads the counts are 0.

    Bases are counted before they are joined; those elsewhere are best left out before (bases.at_places)."""
    at = variants.select("contig", "pos", "ref", "alt").distinct()
    by = ["_tile"] if "_tile" in bases.columns else []
    hits = bases.groupBy("contig", *by, "pos", "base").agg(F.count("*").alias("_n")).drop(*by)
    of = lambda c: F.coalesce(F.sum(F.when(F.col("base") == F.col(c), F.col("_n"))), F.lit(0))
    out = at.join(hits, ["contig", "pos"], "left").groupBy("contig", "pos", "ref", "alt")
    return out.agg(of("ref").alias("n_ref"), of("alt").alias("n_alt"), F.coalesce(F.sum("_n"), F.lit(0)).alias("depth")).withColumn("supported", F.col("n_alt") >= min_reads)


def mutation_spectrum(variants: DataFrame, sample: str) -> DataFrame:
    """Single-base substitutions of each sample by class (A[C>T]G, on pyrimidines), and their share of the sample's.

    variants have ref, alt and around (the reference from one base before to one after)."""
    snv = variants.where("length(ref) = 1 and length(alt) = 1 and ref <> alt and length(around) = 3 and not contains(around, 'N')")
    kind = S.substitution_class(F.col("ref"), F.col("alt"), F.substring("around", 1, 1), F.substring("around", 3, 1))
    n = snv.groupBy(sample, kind.alias("kind")).agg(F.count("*").alias("n"))
    total = n.groupBy(sample).agg(F.sum("n").alias("_t"))
    return n.join(total, sample).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def digested_fragments(genome: DataFrame, motif: str, read_length: int, min_length: int) -> DataFrame:
    """(contig, site, strand, seq): the reads that start at each occurrence of motif and run into the next fragment.

    Neighbouring occurrences bound a fragment that holds both motifs; the forward read starts at the first, the
    reverse read at the second. Reads under min_length are left out. A contig's sites stay within its own row."""
    # Occurrences that do not overlap: the lengths of the pieces between them give their places.
    pieces = F.split(F.upper("seq"), motif)
    places = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda t, x: F.struct((t["at"] + F.length(x) + len(motif)).alias("at"), F.concat(t["all"], F.array(t["at"] + F.length(x))).alias("all")), lambda t: t["all"],
    )
    sites = genome.where("seq is not null").select("contig", "seq", places.alias("_p"))
    ends = F.arrays_zip(F.slice("_p", F.lit(1), F.size("_p") - 1).alias("a"), F.slice("_p", F.lit(2), F.size("_p") - 1).alias("b"))
    spans = sites.where(F.size("_p") > 1).select("contig", F.explode(F.transform(ends, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), F.upper(F.substr("seq", e["a"] + 1, e["b"] + len(motif) - e["a"])).alias("s")))).alias("_f"))
    mates = F.array(
        F.struct(F.col("_f.a").alias("site"), F.lit("+").alias("strand"), F.substring("_f.s", 1, read_length).alias("seq")),
        F.struct(F.col("_f.b").alias("site"), F.lit("-").alias("strand"), F.substring(S.reverse_complement(F.col("_f.s")), 1, read_length).alias("seq")),
    )
    return spans.select("contig", F.explode(mates).alias("_m")).select("contig", "_m.*").where(F.length("seq") >= min_length)


def site_mappability(mapped: DataFrame) -> DataFrame:
    """(contig, site, strand, correct, lost, wrong_gain, safe) from where simulated reads of each site came to lie.

    mapped has the origin (contig, site, strand) and the place found (m_contig, m_site, m_strand; null: unmapped). A
    read is correct at its own place, else lost there and a wrong gain where it lies. A site is safe with one correct
    read and nothing else."""
    same = F.coalesce((F.col("contig") == F.col("m_contig")) & (F.col("site") == F.col("m_site")) & (F.col("strand") == F.col("m_strand")), F.lit(False))
    event = lambda c, s, t, *n: F.struct(F.col(c).alias("contig"), F.col(s).alias("site"), F.col(t).alias("strand"), *[x.cast("long").alias(k) for k, x in zip(("c", "l", "w"), n, strict=True)])
    zero = F.lit(0)
    found = event("m_contig", "m_site", "m_strand", zero, zero, (~same).cast("long"))
    events = mapped.select(F.explode(F.array(event("contig", "site", "strand", same, ~same, zero), found)).alias("_e")).select("_e.*").where("contig is not null")
    out = events.groupBy("contig", "site", "strand").agg(F.sum("c").alias("correct"), F.sum("l").alias("lost"), F.sum("w").alias("wrong_gain"))
    return out.withColumn("safe", F.expr("correct = 1 and lost = 0 and wrong_gain = 0"))


def unmixed(rows: DataFrame, probabilities: DataFrame, unit: Column, seed: int = 1) -> DataFrame:
    """Rows (sm, bin) with signal A or B: A with the probability p of their (bin, sm); null where that is unknown.

    The draw is a hash of unit, so that the mates of a pair, and a lost task's second run, come to the same end."""
    u = F.pmod(F.xxhash64(unit, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return rows.join(probabilities.select("bin", "sm", "p"), ["bin", "sm"], "left").withColumn("signal", F.when(u < F.col("p"), "A").when(F.col("p").isNotNull(), "B")).drop("p")
