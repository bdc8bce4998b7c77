"""Sample sheets, recalibration reports, tables of text and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.text import _lines

#: Sections of a sample sheet that are keyed by library.
LIBRARY_SECTIONS = ("marks", "condition", "libtype", "library_layout")


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, value) of JSON sheets of the form {section: {key: value}} (S20); what lies deeper stays JSON text.

    Several sheets are merged: where two have the same section and key, the later file by name counts."""
    sheet = F.from_json("value", "map<string,map<string,string>>")
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), sheet.alias("_s"))
    keys = files.select("_file", F.explode("_s").alias("section", "_k")).select("_file", "section", F.explode("_k").alias("key", "value"))
    return keys.groupBy("section", "key").agg(F.max_by("value", "_file").alias("value"))


def without_libraries(sheet: DataFrame, libraries: list[str] = (), marks: list[str] = ()) -> DataFrame:
    """A sheet without libraries, and without those of a mark."""
    marked = sheet.where((F.col("section") == "marks") & F.col("value").isin(*marks)).select("key")
    gone = marked.union(sheet.where(F.col("key").isin(*libraries)).select("key")).distinct().withColumnRenamed("key", "_gone")
    return sheet.join(gone, (F.col("key") == F.col("_gone")) & F.col("section").isin(*LIBRARY_SECTIONS), "left_anti")


def well_conditions(sheet: DataFrame, layout: str) -> DataFrame:
    """(cell_index, well, condition) of a layout: its wells by the format that layout_format names."""
    pick = lambda section, key: sheet.where((F.col("section") == section) & (F.col("key") == key))
    form = pick("layout_format", layout).select(F.col("value").alias("_f"))
    wells = sheet.where("section = 'well2index'").join(form, F.col("key") == F.col("_f")).select(F.explode(F.from_json("value", "map<string,int>")).alias("well", "cell_index"))
    conditions = pick("layouts", layout).select(F.explode(F.from_json("value", "map<string,string>")).alias("_w", "condition"))
    return wells.join(conditions, F.col("well") == F.col("_w")).select("cell_index", "well", "condition")


def report_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, table, row, column, value) of the tables in recalibration reports (S21).

    A table begins with a line of '#:', a word, its numbers of columns and rows and the formats, between colons; a line with its
    name and one with its columns follow. Lines with another number of fields are left out."""
    lines = F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x))
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), lines.alias("_l"))
    first = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.get("_l", i).rlike(r"^#:\w+:\d+:\d+:"))
    tables = text.select("file", "_l", F.explode(first).alias("_i"))
    head = lambda k: F.get("_l", F.col("_i") + k)
    tables = tables.select(
        "file", F.split_part(head(1), F.lit(":"), F.lit(3)).alias("table"), F.split(head(2), r"\s+").alias("_names"), F.split_part(head(0), F.lit(":"), F.lit(3)).cast("int").alias("_n"),
        F.slice("_l", F.col("_i") + 4, F.split_part(head(0), F.lit(":"), F.lit(4)).cast("int")).alias("_rows"),
    )
    rows = tables.select("file", "table", "_names", "_n", F.posexplode("_rows").alias("row", "_line")).withColumn("_v", F.split("_line", r"\s+"))
    cells = rows.where("size(_v) = _n").select("file", "table", "row", F.explode(F.arrays_zip("_names", "_v")).alias("c"))
    return cells.select("file", "table", "row", F.col("c._names").alias("column"), F.col("c._v").alias("value"))


def tabbed(spark: SparkSession, path: str) -> DataFrame:
    """A table of tabbed text whose first line names its columns, all of them text (S17)."""
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start_, end_, value) of bedGraph lines (S16); lines of comments, tracks and browsers are left out."""
    p = F.split("value", r"\s+")
    rows = _lines(spark, path).where(~F.col("value").rlike("^(track|browser)"))
    return rows.select(p[0].alias("contig"), p[1].cast("long").alias("start_"), p[2].cast("long").alias("end_"), p[3].cast("double").alias("value"))


def binned_track(track: DataFrame, size: int) -> DataFrame:
    """(contig, bin_start, value): the mean of a track over the bases of each bin that it covers."""
    bins = F.sequence(F.floor(F.col("start_") / size), F.floor((F.col("end_") - 1) / size))
    rows = track.where("end_ > start_").withColumn("bin_start", F.explode(F.transform(bins, lambda b: b * size)))
    n = F.least("end_", F.col("bin_start") + size) - F.greatest("start_", "bin_start")
    return rows.withColumn("_n", n).groupBy("contig", "bin_start").agg((F.sum(F.col("value") * F.col("_n")) / F.sum("_n")).alias("value"))
