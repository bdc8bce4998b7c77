"""Reports over reads, cuts, tracks and variants, and the second pass over transcript contamination."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.functions import sequence as S

# What the report calls each tag, and each value of the two assignment tags.
TAG_NAMES = {"DS": "Assigned to cut site", "GN": "Assigned to gene", "IN": "Overlapping with intron", "JN": "Intron/exon junction"}
VALUE_NAMES = {
    "EX": {"Unassigned_NoFeatures": "Not assigned to exon", "Assigned": "Assigned to exon", None: "Overlapping with exon"},
    "XS": {"Unassigned_NoFeatures": "Not assigned to gene/intron", "Assigned": "Assigned to gene/intron", None: "Unknown gene/intron assignment"},
}
PREFIXES = {"Is": "Sequencer_", "LY": "Library_"}


def tag_report(reads: DataFrame) -> DataFrame:
    """Q9. (category, n) of the tags of reads that are no duplicates; each mate counts for itself, null tags for nothing."""
    t = F.col("tags")
    each = [F.when(t[k].isNotNull(), F.lit(v)) for k, v in TAG_NAMES.items()]
    for k, names in VALUE_NAMES.items():
        known = [(x, label) for x, label in names.items() if x is not None]
        of = F.when(t[k] == known[0][0], known[0][1]).when(t[k] == known[1][0], known[1][1])
        each.append(of.when(t[k].isNotNull(), names[None]))
    each += [F.concat(F.lit(p), t[k]) for k, p in PREFIXES.items()]
    rows = reads.where("not duplicate").select(F.explode(F.array(*each)).alias("category")).where("category is not null")
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def context_totals(symbols: DataFrame, *by: str) -> DataFrame:
    """Q11. Calls by context symbol, of first mates that are neither duplicates nor rejected (first mates, as the report means)."""
    rows = symbols.where("is_read1 and not duplicate and not qcfail and symbol <> '.'")
    return rows.groupBy(*by, "symbol").agg(F.count("*").alias("n"))


def plate_quality(cells: DataFrame, contaminants: DataFrame, labels: DataFrame, min_molecules: int, max_fraction: float) -> DataFrame:
    """Q17. Cells (cell, total, molecules) with their condition (labels: cell, label) and share of foreign reads (contaminants:
    cell, fraction), and whether they pass both thresholds. A cell without a label has null, without foreign reads 0."""
    out = cells.join(contaminants.select("cell", "fraction"), "cell", "left").join(labels.select("cell", "label"), "cell", "left").fillna(0.0, ["fraction"])
    return out.withColumn("passes", (F.col("molecules") >= min_molecules) & (F.col("fraction") <= max_fraction))


def primer_histogram(fragments: DataFrame, size: Column, max_size: int, width: int, primer: str = "primer") -> DataFrame:
    """Q19. (size_bin, primer, n): random primers by fragment size; sizes from max_size on are in the last bin, primers with N out."""
    place = F.floor(F.least(F.lit(max_size - 1), F.abs(size)) / float(width)).cast("long") * width
    rows = fragments.where(F.col(primer).isNotNull() & ~F.contains(F.col(primer), F.lit("N")))
    return rows.groupBy(place.alias("size_bin"), F.col(primer).alias("primer")).agg(F.count("*").alias("n"))


def reaction_sizes(fragments: DataFrame, molecule: list[str], primer: str, size: Column) -> DataFrame:
    """Q20. (reactions, molecules, mean_size): molecules by how many primers started on them, and the mean of their sizes."""
    one = fragments.groupBy(*molecule).agg(F.count_distinct(primer).alias("reactions"), F.avg(size).alias("_s"))
    return one.groupBy("reactions").agg(F.count("*").alias("molecules"), F.avg("_s").alias("mean_size"))


def read_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """J16. (query_name, is_read1, only_in) of mates that one of two sets lacks."""
    key = ["query_name", "is_read1"]
    left, right = a.select(*key).distinct().withColumn("_a", F.lit(True)), b.select(*key).distinct().withColumn("_b", F.lit(True))
    out = left.join(right, key, "full").where("_a is null or _b is null")
    return out.select(*key, F.when(F.col("_a").isNotNull(), "a").otherwise("b").alias("only_in"))


def nearest_opposite(cuts: DataFrame, max_range: int, size: int = 1 << 18, position: str = "ds") -> DataFrame:
    """J14. (kind, distance, n): from each distinct cut (sm, contig, is_reverse, position) to the nearest cut of the other strand
    above and below it, nearer than max_range. Samples with one cut or none on a strand of a contig are left out.

    Windows are cut at every size bases, with the cuts of max_range around them, so no contig of a deep sample is one task."""
    place = F.col(position)
    sites = cuts.where(place.isNotNull() & F.col("sm").isNotNull()).select("sm", "contig", "is_reverse", place.alias("p")).distinct()
    both = sites.groupBy("sm", "contig").agg(F.sum(F.col("is_reverse").cast("int")).alias("_r"), F.count("*").alias("_n"))
    sites = sites.join(both.where("_r > 1 and _n - _r > 1").select("sm", "contig"), ["sm", "contig"], "left_semi")
    places = sites.groupBy("sm", "contig", "p").agg(F.bool_or(~F.col("is_reverse")).alias("_f"), F.bool_or("is_reverse").alias("_r"))
    home = F.floor(F.col("p") / float(size))
    near = F.array_distinct(F.array(F.floor((F.col("p") - max_range) / float(size)), home, F.floor((F.col("p") + max_range) / float(size))))
    rows = places.withColumn("_home", home).withColumn("_cell", F.explode(near))
    # Frames that only grow cost the same for every row, however many cuts lie within the range.
    w = Window.partitionBy("sm", "contig", "_cell")
    above, below = w.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1), w.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda f, strand, frame: f(F.when(F.col(strand), F.col("p"))).over(frame)
    found = rows.withColumns({
        "_fa": of(F.min, "_r", above) - F.col("p"), "_fb": F.col("p") - of(F.max, "_r", below),
        "_ra": of(F.min, "_f", above) - F.col("p"), "_rb": F.col("p") - of(F.max, "_f", below),
    }).where("_cell = _home")
    side = lambda name, strand, c: F.when(F.col(strand) & (F.col(c) < max_range), F.struct(F.lit(name).alias("kind"), F.col(c).alias("distance")))
    kinds = F.array(side("forward_above", "_f", "_fa"), side("forward_below", "_f", "_fb"), side("reverse_above", "_r", "_ra"), side("reverse_below", "_r", "_rb"))
    return found.select(F.explode(kinds).alias("x")).select("x.*").where("distance is not null").groupBy("kind", "distance").agg(F.count("*").alias("n"))


def track_difference(a: DataFrame, b: DataFrame, value: str = "n") -> DataFrame:
    """N12. (contig, bin_start, bin_end, difference): absolute difference of two tracks; null where one has no value."""
    key = ["contig", "bin_start", "bin_end"]
    out = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key, "full")
    return out.select(*key, F.abs(F.col("_a") - F.col("_b")).alias("difference"))


def pair_filter(reads: DataFrame, min_mapq: int = 0, multimapping: bool = False, homopolymer: int | None = None) -> DataFrame:
    """F21-F23. Reads of the pairs whose mates all have min_mapq, that map at all (unless multimapping), and that hold no
    homopolymer of so many bases."""
    g = reads.groupBy("query_name").agg(
        F.min("mapq").alias("_least"), F.max("mapq").alias("_most"), F.max(S.homopolymer(F.col("seq"), homopolymer) if homopolymer else F.lit(False)).alias("_h")
    )
    keep = g.where((F.col("_least") >= min_mapq) & ~F.col("_h") & (F.lit(multimapping) | (F.col("_most") > 0)))
    return reads.join(keep.select("query_name"), "query_name", "left_semi")


def frequency_filter(calls: DataFrame, least: float) -> DataFrame:
    """F25. Rows (ad_ref, ad_alt) whose reference share lies in [least, 1 - least]; rows without reads are left out."""
    share = F.col("ad_ref") / F.nullif(F.col("ad_ref") + F.col("ad_alt"), F.lit(0))
    return calls.where(share.between(least, 1 - least))


def heterozygous(support: DataFrame, least: float = 0.3) -> DataFrame:
    """L8. Variants (n_alt, depth) whose alternative has more than a share of the bases there; without bases none is kept."""
    return support.where((F.col("depth") > 0) & (F.col("n_alt") / F.col("depth") > least))


# Motifs of transcriptome material in a T-CHIC pair, where they are looked for, and the reasons written.
POLY_T = "T" * 23
ADAPTERS_NEAR_START = ("AGTCCGACGAT", "GTTCTACAGT")
T7_PROMOTER = "TAATACGACTCACTATAGGG"


def transcript_pass(pairs: DataFrame, expected: DataFrame, umi: int = 6) -> DataFrame:
    """X6, X7. Pairs (r1, q1, index, rest1, rest2, rr) of a demultiplexed T-CHIC run with lh, lq, dt and the transcript's rx_tx.

    expected (index, tx_barcode) names each cell's transcriptome barcode. A barcode followed by five T in the first mate, or in
    the reverse complement of the second, makes the pair VASA with the bases before it as UMI (null if there are none) and the
    second mate trimmed; else a run of 23 T is rejected, and a promoter or adapter marks the pair. Nulls stay null."""
    rows = pairs.join(expected.select("index", "tx_barcode"), "index", "left")
    probe, rc = F.concat("tx_barcode", F.lit("TTTTT")), S.reverse_complement(F.col("rest2"))
    at1, at2 = F.position(probe, F.col("rest1")), F.position(probe, rc)
    seq, end = F.when(at1 > 0, F.col("rest1")).otherwise(rc), F.when(at1 > 0, at1).otherwise(at2) - 1
    found = F.coalesce((at1 > 0) | (at2 > 0), F.lit(False))
    poly = F.contains(F.col("rest1"), F.lit(POLY_T)) | F.contains(F.col("rest2"), F.lit(POLY_T))
    start = F.substring("rest1", 1, 30)
    marked = F.contains(F.col("rest1"), F.lit(T7_PROMOTER))
    for motif in ADAPTERS_NEAR_START:
        marked = marked | F.contains(start, F.lit(motif))
    first = F.greatest(end - umi, F.lit(0))
    return rows.withColumns({
        "lh": F.substring("r1", 12, 2), "lq": F.substring("q1", 12, 2), "dt": F.when(found | (~poly & marked), "VASA").otherwise("CHIC"),
        "rx_tx": F.when(found & (end > 0), F.substr(seq, first + 1, end - first)),
        "rr": F.coalesce(F.col("rr"), F.when(~found & poly, "PolyT").when(~found & marked, "T7_found")),
        "rest2": F.when(found, S.trim_poly_tail(F.col("rest2"))).otherwise(F.col("rest2")),
    }).drop("tx_barcode")


def bias_corrected(counts: DataFrame, bins: DataFrame, features: list[str], stable: Column, trees: int = 100, seed: int = 1) -> DataFrame:
    """N6. Counts (cell, bin, n) over what a random forest expects of their bin, from the bins' features (GC, sites, sizes).

    The forest learns from the totals of the bins where stable holds, times two; one row a bin, so the genome bounds it.
    Features that are null count as 0. Bins that the forest expects nothing of give 0."""
    totals = counts.groupBy("bin").agg(F.sum("n").cast("double").alias("_t"))
    rows = bins.select("bin", stable.alias("_stable"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]).join(totals, "bin", "left").fillna(0.0, ["_t"])
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    model = RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="expected", numTrees=trees, featureSubsetStrategy="all", seed=seed).fit(data.where("_stable").withColumn("_y", F.col("_t") * 2))
    expected = model.transform(data).select("bin", "expected")
    return counts.join(expected, "bin", "left").withColumn("corrected", F.coalesce(F.col("n") / F.nullif(F.col("expected"), F.lit(0.0)), F.lit(0.0)))
