"""Reads at chosen places: pile-ups with their mates, coverage by sample, and random places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.operators import bases as B

#: Places on the contigs' common axis that share a key in the join of random places.
TILE = 1 << 20


def in_region(bases: DataFrame, contig: str, start: int, stop: int) -> DataFrame:
    """Aligned bases from start up to, but not at, stop."""
    return bases.where((F.col("contig") == contig) & (F.col("pos") >= start) & (F.col("pos") < stop))


def mate_pileup(pieces: DataFrame, reads: DataFrame, places: DataFrame) -> DataFrame:
    """(contig, pos, query_name, read1, read2): the fragments with an aligned base at a place (contig, pos), with the read_index
    of both mates, also of one that does not reach the place. A mate that reads does not have is null; of several
    alignments of a mate, the first by read_index counts. pieces are the aligned stretches; reads are without supplementary alignments.

    Stretches at places and mates come together once, by name; a place is given by the first stretch of a fragment that holds it."""
    none = F.lit(None).cast("long")
    at = B.at_places(pieces, places).select("query_name", F.struct("contig", "pos", "_mask").alias("_p"), none.alias("_1"), none.alias("_2"), F.lit(False).alias("_known"))
    index = F.col("read_index").cast("long")
    mates = reads.select("query_name", F.lit(None).cast(at.schema["_p"].dataType).alias("_p"), F.when(~F.col("is_read2"), index).alias("_1"), F.when(F.col("is_read2"), index).alias("_2"), F.lit(True).alias("_known"))
    each = at.union(mates).where("query_name is not null").groupBy("query_name").agg(F.collect_list("_p").alias("_all"), F.min("_1").alias("read1"), F.min("_2").alias("read2"), F.max("_known").alias("_known"))
    rows = each.where("_known and size(_all) > 0").select("query_name", "read1", "read2", "_all", F.posexplode("_all").alias("_i", "_p"))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.length("_p._mask") - 1))).where(F.substr("_p._mask", F.col("_k") + 1, F.lit(1)) == "1")
    pos = F.col("_p.pos") + F.col("_k")
    seen = F.exists(F.slice("_all", F.lit(1), F.col("_i")), lambda x: (x["contig"] == F.col("_p.contig")) & (x["pos"] <= pos) & (pos < x["pos"] + F.length(x["_mask"])))
    return rows.where(F.when(F.col("_i") == 0, True).otherwise(~seen)).select("_p.contig", pos.alias("pos"), "query_name", "read1", "read2")


def coverage_at(pieces: DataFrame, places: DataFrame, dedup: bool = True, qc: bool = True) -> DataFrame:
    """(contig, pos, sm, n): reads of each sample with an aligned base at a place, without duplicates and failed reads where asked.
    pieces are the aligned stretches."""
    kept = pieces
    if dedup:
        kept = kept.where(~F.col("duplicate"))
    if qc:
        kept = kept.where(~F.col("qcfail"))
    return B.bases_of(B.at_places(kept, places), "sm", "_tile").groupBy("contig", "_tile", "pos", "sm").agg(F.count("*").alias("n")).drop("_tile")


def random_places(contigs: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(place, contig, pos): n places, each base of all contigs (contig, length_) as likely as any other, with repeats.

    A place's number and the seed decide it, so that it does not depend on partitions. The running sum over contigs is one
    task, which a reference's number of contigs bounds."""
    spark = contigs.sparkSession
    high = F.sum("length_").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, 0))
    axis = contigs.where("length_ > 0").select("contig", high.alias("_high"), (high - F.col("length_")).alias("_low"))
    total = axis.agg(F.max("_high")).first()[0]
    if total is None:
        return spark.createDataFrame([], "place long, contig string, pos long")
    drawn = spark.range(n).select(F.col("id").alias("place"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("_x"))
    drawn = drawn.withColumn("_tile", F.floor(F.col("_x") / TILE))
    tiles = axis.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("_low") / TILE), F.floor((F.col("_high") - 1) / TILE))))
    hit = drawn.join(tiles, "_tile").where("_x >= _low and _x < _high")
    return hit.select("place", "contig", (F.col("_x") - F.col("_low")).alias("pos"))


def transition_tags(bases: DataFrame, consensus: DataFrame, *molecule: str) -> DataFrame:
    """(molecule, mM, pP, pF, pR, pE) from the bases that agree with their molecule's consensus (molecule, contig, pos, base),
    seen on the sequenced strand: mismatches, transitions, those between A and G, those between C and T, and the
    places 'contig:pos>' of all transitions in order. A molecule without such a base gives no row."""
    agree = bases.join(consensus.select(*molecule, "contig", "pos", "base"), [*molecule, "contig", "pos", "base"])
    turned = {c: F.when(F.col("is_reverse"), F.translate(c, "ACGT", "TGCA")).otherwise(F.col(c)) for c in ("ref", "base")}
    rows = agree.withColumns({"_r": turned["ref"], "_q": turned["base"]})
    pair = F.concat("_r", F.lit(">"), "_q")
    ag, ct = pair.isin("A>G", "G>A"), pair.isin("C>T", "T>C")
    place = F.when(ag | ct, F.struct("contig", "pos", F.concat_ws("", "contig", F.lit(":"), (F.col("pos") + 1).cast("string"), F.lit(" "), pair).alias("t")))
    n = lambda c: F.sum(c.cast("long"))
    sums = rows.groupBy(*molecule).agg(n(F.col("_r") != F.col("_q")).alias("mM"), n(ag | ct).alias("pP"), n(ag).alias("pF"), n(ct).alias("pR"), F.array_sort(F.collect_list(place)).alias("_p"))
    return sums.withColumn("pE", F.array_join(F.transform("_p", lambda p: p["t"]), ",")).drop("_p")
