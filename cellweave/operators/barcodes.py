"""Barcode whitelists with error tolerance, and demultiplexing layouts as rows of one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ACTGN"


def neighbours(barcode: Column, distance: int) -> Column:
    """All words at one substitution, applied distance times; the word itself is among them."""
    words = F.array(barcode)
    for _ in range(distance):
        step = lambda w: F.flatten(
            F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(F.array(*[F.lit(c) for c in ALPHABET]), lambda c: F.concat(F.substr(w, F.lit(1), i - 1), c, F.substr(w, i + 1))))
        )
        words = F.array_distinct(F.flatten(F.transform(words, step)))
    return words


def expanded(whitelist: DataFrame, distance: int) -> DataFrame:
    """(observed, barcode, index, hd): every word within distance of one barcode that is nearest to no other; ties are dropped,
    and a barcode itself always stands for itself."""
    near = whitelist.select("barcode", "index", F.explode(neighbours(F.col("barcode"), distance)).alias("observed"))
    # here N is a letter of its own
    d = F.length("barcode") - F.size(F.filter(F.arrays_zip(F.split("barcode", "").alias("a"), F.split("observed", "").alias("b")), lambda p: p["a"] == p["b"]))
    near = near.withColumn("hd", d)
    best = near.groupBy("observed").agg(F.min(F.struct("hd", "barcode", "index")).alias("b"), F.min("hd").alias("hd"), F.collect_set(F.struct("hd", "barcode")).alias("all"))
    unique = F.size(F.filter("all", lambda x: x["hd"] == F.col("hd"))) == 1
    return best.where(unique).select("observed", F.col("b.barcode").alias("barcode"), F.col("b.index").alias("index"), "hd")


def corrected(reads: DataFrame, table: DataFrame, observed: str) -> DataFrame:
    """Reads with their barcode, index and distance; null where none fits."""
    return reads.join(table.withColumnRenamed("observed", "_o"), F.col(observed) == F.col("_o"), "left").drop("_o")


@dataclass(frozen=True)
class Layout:
    """Slices (read, start, length) of UMI and barcode, the whitelist's alias and the random primer (read, length)."""

    name: str
    umi: tuple[tuple[int, int, int], ...]
    barcode: tuple[tuple[int, int, int], ...]
    alias: str
    primer: tuple[int, int] | None = None
    detect: bool = True

    def cut(self, which: str) -> Column:
        return F.concat(*[F.substring(f"r{r}", s + 1, n) for r, s, n in getattr(self, which)]) if getattr(self, which) else F.lit("")

    def remainder(self, read: int) -> Column:
        """What is left of a read after its UMI, barcode and random primer."""
        ends = [s + n for r, s, n in (*self.umi, *self.barcode) if r == read] + ([self.primer[1]] if self.primer and self.primer[0] == read else [])
        return F.substr(F.col(f"r{read}"), F.lit(max(ends, default=0) + 1))


def _plain(name, umi, barcode, alias, primer=None, detect=True):
    return Layout(name, (umi,) if umi else (), (barcode,), alias, primer, detect)


# The layouts of the protocols.
LAYOUTS = {
    x.name: x
    for x in (
        _plain("CS1C8U4", (1, 8, 4), (1, 0, 8), "celseq1", (2, 6)),
        _plain("CS2C8U6", (1, 0, 6), (1, 6, 8), "celseq2", (2, 6)),
        _plain("CS2C8U6NH", (1, 0, 6), (1, 6, 8), "celseq2", None, False),
        _plain("CS2C8U6S", (2, 0, 6), (2, 6, 8), "celseq2", (1, 6)),
        _plain("CS2C8U8", (1, 0, 8), (1, 8, 8), "celseq2", (2, 6)),
        _plain("CS2C8U8S", (2, 0, 8), (2, 8, 8), "celseq2", (2, 6)),
        _plain("CS2C8U8NNLA", (1, 0, 8), (1, 8, 8), "celseq2_noNla", (2, 6), False),
        _plain("DamID2", (1, 0, 3), (1, 3, 10), "DamID2"),
        _plain("DamID2_8bp_noCA", (1, 0, 3), (1, 3, 8), "DamID2_8bp"),
        _plain("DamAndT", (1, 0, 3), (1, 3, 10), "DamAndT"),
        Layout("DamID2_3u4b3u6b", ((1, 0, 3), (1, 7, 3)), ((1, 3, 4), (1, 10, 4)), "DamID2_scattered_8bp"),
        _plain("MSPJIC8U3", (1, 0, 3), (1, 3, 8), "maya_mspj1"),
        _plain("NLAIII96C8U3", (1, 0, 3), (1, 3, 8), "lennart96NLA", (2, 6)),
        _plain("NLAIII384C8U3", (1, 0, 3), (1, 3, 8), "maya_384NLA", (2, 6)),
        _plain("NLAIII384C8U3SE", (1, 0, 3), (1, 3, 8), "maya_384NLA"),
        _plain("NLAIII96C8U3SE", (1, 0, 3), (1, 3, 8), "lennart96NLA"),
        _plain("CHROMC16U12", (1, 16, 12), (1, 0, 16), "10x_3M-february-2018", None, False),
        _plain("scCHIC384C8U3", (1, 0, 3), (1, 3, 8), "maya_384NLA", (2, 6)),
        _plain("scCHIC384C8U3l", (1, 0, 3), (1, 3, 8), "maya_384NLA", None, False),
        _plain("scCHIC384C8U3se", (1, 0, 3), (1, 3, 8), "maya_384NLA"),
        _plain("TCHIC", (1, 0, 3), (1, 3, 8), "maya_384NLA", None, False),
        _plain("SCARC8R1", None, (1, 0, 8), "scartrace"),
        _plain("SCARC8R2", None, (2, 0, 8), "scartrace"),
        _plain("SCARC8R2R4", None, (2, 0, 8), "scartrace", (1, 4)),
    )
}


def demultiplexed(pairs: DataFrame, layout: Layout, table: DataFrame) -> DataFrame:
    """Pairs (header, r1, r2) with RX, the raw and the corrected barcode and what is left of both reads; RR names why a pair
    without a barcode is rejected."""
    rows = pairs.withColumn("rx", layout.cut("umi")).withColumn("raw_barcode", layout.cut("barcode"))
    out = corrected(rows, F.broadcast(table), "raw_barcode") if table.count() <= 2_000_000 else corrected(rows, table, "raw_barcode")
    return out.withColumns({"rest1": layout.remainder(1), "rest2": layout.remainder(2), "rr": F.when(F.col("barcode").isNull(), "barcode"), "mx": F.lit(layout.name)})


def yields(pairs: DataFrame, layouts: list[tuple[Layout, DataFrame]], least_percent: float, top: int) -> DataFrame:
    """The top layouts by the share of pairs whose barcode is known, of those with least_percent or more."""
    out = None
    for layout, table in layouts:
        got = demultiplexed(pairs, layout, table).agg((100.0 * F.sum(F.col("barcode").isNotNull().cast("int")) / F.count("*")).alias("percent")).withColumn("layout", F.lit(layout.name))
        out = got if out is None else out.unionByName(got)
    return out.where(F.col("percent") >= least_percent).orderBy(F.desc("percent"), "layout").limit(top)


def tagged_header(tags: dict[str, Column]) -> Column:
    """k:v;k:v of the tags that have a value; longer than 255 characters is an error."""
    text = F.concat_ws(";", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}:"), v.cast("string"))) for k, v in tags.items()])
    return F.when(F.length(text) > 255, F.raise_error(F.lit("the tagged header has more than 255 characters"))).otherwise(text)
