from pyspark.sql import functions as F

from cellweave.streaming import molecules


def test_streamed_molecules(spark, tmp_path):
    rows = [(1, "c", "chr1", False, 100, 150, "CAT"), (2, "c", "chr1", False, 100, 160, "CAT"), (3, "c", "chr1", False, 100, 150, "GGG"), (4, "c", "chr1", False, 90_000, 90_050, "CAT")]
    schema = "read_index long, sm string, contig string, is_reverse boolean, site long, end_ long, rx string"
    for k, part in enumerate((rows[:3], rows[3:], [(5, "d", "chr1", False, 190_000, 190_050, "CAT")], [(6, "d", "chr1", False, 290_000, 290_050, "CAT")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = molecules.streamed(stream, [("chr1", 300_000)]).writeStream.format("memory").queryName("mols").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.molecule, r.umi, r.fragments) for r in spark.table("mols").collect()}
    assert {(1, "CAT", 2), (3, "GGG", 1), (4, "CAT", 1)} <= got


def test_contigs_follow_one_another(spark, tmp_path):
    """Reads of a second contig, whose coordinates begin anew, are not late."""
    batches = [[(1, "chr1", 100)], [(2, "chr1", 900_000)], [(3, "chr2", 100), (4, "chr2", 100)], [(5, "chr2", 200_000)], [(6, "chr3", 50)], [(7, "chr3", 60_000)]]
    schema = "read_index long, sm string, contig string, is_reverse boolean, site long, end_ long, rx string"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, "c", contig, False, p, p + 50, "CAT") for i, contig, p in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    contigs = [("chr1", 1_000_000), ("chr2", 300_000), ("chr3", 100_000)]
    q = molecules.streamed(stream, contigs).writeStream.format("memory").queryName("contigs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.molecule, r.contig, r.fragments) for r in spark.table("contigs").collect()}
    assert {(1, "chr1", 1), (2, "chr1", 1), (3, "chr2", 2), (5, "chr2", 1), (6, "chr3", 1)} <= got


def test_windowed_counts(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = molecules.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    n = spark.table("counts").agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
