"""BAM files: alignments decoded from BGZF blocks, a file at a time and a batch of rows at a time, and written in sorted parts."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "file string, query_name string, flag int, contig string, start_ long, end_ long, mapq int, cigar string, mate_contig string, mate_start long, isize long, seq string, qual string, tags map<string,string>"
)
# Fixed values of the format: flag bits, codes of bases and of CIGAR operations, and the sizes of tag values.
FLAGS = {"is_paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "is_reverse": 16, "is_read1": 64, "is_read2": 128, "secondary": 256, "qcfail": 512, "duplicate": 1024, "supplementary": 2048}
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


class _Stream:
    """Bytes of a file of gzip members; no more than what is asked for is held besides the file's own."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.ready = memoryview(data), 0, bytearray()

    def take(self, n: int) -> bytes:
        while len(self.ready) < n and self.at < len(self.data):
            d = zlib.decompressobj(31)
            size = struct.unpack_from("<H", self.data, self.at + 16)[0] + 1  # the block's own length, in its extra field
            self.ready += d.decompress(self.data[self.at : self.at + size])
            self.at += size
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def _header(s: _Stream) -> tuple[str, list[tuple[str, int]]]:
    if s.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = s.take(struct.unpack("<i", s.take(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        name = s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", s.take(4))[0]))
    return text, contigs


def _tags(b: bytes) -> dict[str, str]:
    out, i = {}, 0
    while i < len(b):
        name, kind = b[i : i + 2].decode(), chr(b[i + 2])
        i += 3
        if kind == "A":
            out[name], i = chr(b[i]), i + 1
        elif kind in "ZH":
            end = b.index(0, i)
            out[name], i = b[i:end].decode(), end + 1
        elif kind == "B":
            of, n = NUMBERS[chr(b[i])], struct.unpack_from("<i", b, i + 1)[0]
            out[name] = ",".join([chr(b[i]), *map(str, struct.unpack_from(f"<{n}{of}", b, i + 5))])
            i += 5 + n * struct.calcsize(of)
        else:
            of = NUMBERS[kind]
            out[name] = str(struct.unpack_from(f"<{of}", b, i)[0])
            i += struct.calcsize(of)
    return out


def _record(b: bytes, contigs: list[tuple[str, int]]) -> tuple:
    ref, pos, name_n, mapq, _, cigar_n, flag, n, mate, mate_pos, isize = struct.unpack_from("<iiBBHHHiiii", b)
    i = 32 + name_n
    ops = [(x >> 4, OPERATIONS[x & 15]) for x in struct.unpack_from(f"<{cigar_n}I", b, i)]
    i += 4 * cigar_n
    packed = b[i : i + (n + 1) // 2]
    i += (n + 1) // 2
    quals = b[i : i + n]
    seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:n] or "*"
    span = sum(k for k, op in ops if op in "MDN=X")
    of = lambda k: contigs[k][0] if k >= 0 else None
    return (
        b[32 : 31 + name_n].decode(), flag, of(ref), pos, pos + span, mapq, "".join(f"{k}{op}" for k, op in ops) or "*", of(mate), mate_pos, isize, seq,
        "*" if not n or quals[0] == 255 else "".join(chr(q + 33) for q in quals), _tags(b[i + n :]),
    )


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
    for files in batches:
        for path, content in zip(files["path"], files["content"], strict=True):
            s = _Stream(content)
            _, contigs = _header(s)
            rows = []
            while size := s.take(4):
                rows.append(_record(s.take(struct.unpack("<i", size)[0]), contigs))
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=names).assign(file=path)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names).assign(file=path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("path", "content")


def bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files (S2): fixed fields, flags, 0-based half-open start_ and end_, and the tags as a map of text.

    Each file is one task and read whole (Spark's limit is 2 GB a file), so large runs come as a file for each contig or
    cell; rows leave in batches. No index is needed: filters on the columns apply after decoding. Unmapped reads have a
    null contig and start -1. A file of no reads gives no rows."""
    rows = _files(spark, path).mapInPandas(_decoded, SCHEMA)
    return rows.select("*", *[(F.col("flag").bitwiseAND(bit) != 0).alias(k) for k, bit in FLAGS.items()])


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(file, contig, length_) of the headers of BAM files (S11)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for at, content in zip(files["path"], files["content"], strict=True):
                found = _header(_Stream(content))[1]
                yield pd.DataFrame({"file": [at] * len(found), "contig": [c for c, _ in found], "length_": [n for _, n in found]})

    return _files(spark, path).mapInPandas(work, "file string, contig string, length_ long")


# -- writing ----------------------------------------------------------------------------------------------------------

# Fixed values of the format: a block's header but for its size, the empty block that ends a file, and the bins' levels.
_BLOCK = bytes.fromhex("1f8b08040000000000ff060042430200")
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_BINS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
#: Tags written as numbers; all others are written as text.
NUMERIC_TAGS = ("NM", "NH", "AS", "XS", "DS", "RC", "af", "rd", "rt", "fS", "fe", "TF")
#: Alignments in a part.
PART = 200_000


def _blocks(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 65_000):
        part = data[i : i + 65_000]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += _BLOCK + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return bytes(out)


def _bin(start: int, end: int) -> int:
    for shift, first in _BINS:
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def _encoded(r, numeric: frozenset[str]) -> bytes:
    """An alignment's bytes; r has the fields of SCHEMA, with the contigs as numbers."""
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", r.cigar or "")]
    span = sum(n for n, op in ops if op in "MDN=X")
    seq = "" if r.seq in (None, "*") else r.seq
    codes = [max(BASES.find(c), 0) if c == "=" or c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    qual = b"\xff" * len(seq) if r.qual in (None, "*") else bytes(ord(c) - 33 for c in r.qual)
    name = (r.query_name or "*").encode() + b"\0"
    tags = bytearray()
    for k, v in sorted((r.tags or {}).items() if isinstance(r.tags, dict) else r.tags or []):
        if v is None:
            continue
        number = k in numeric and re.fullmatch(r"-?\d{1,9}", v)
        tags += k.encode() + (b"i" + struct.pack("<i", int(v)) if number else b"Z" + v.encode() + b"\0")
    start = max(int(r.start_), -1)
    fixed = struct.pack("<iiBBHHHiiii", int(r.ref), start, len(name), int(r.mapq), _bin(max(start, 0), max(start, 0) + max(span, 1)), len(ops), int(r.flag), len(seq), int(r.mate), int(r.mate_start), int(r.isize))
    body = fixed + name + b"".join(struct.pack("<I", n << 4 | OPERATIONS.index(op)) for n, op in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + qual + bytes(tags)
    return struct.pack("<i", len(body)) + body


def header_text(contigs: list[tuple[str, int]], read_groups: list[dict[str, str]] = (), program: dict[str, str] | None = None) -> str:
    lines = ["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{c}\tLN:{n}" for c, n in contigs]]
    lines += ["\t".join(["@RG", *[f"{k}:{v}" for k, v in g.items()]]) for g in read_groups]
    if program:
        lines.append("\t".join(["@PG", *[f"{k}:{v}" for k, v in program.items()]]))
    return "\n".join(lines) + "\n"


def write_bam(reads: DataFrame, contigs: DataFrame, path: str, read_groups: list[dict[str, str]] = (), program: dict[str, str] | None = None, numeric_tags: tuple[str, ...] = NUMERIC_TAGS, part: int = PART) -> None:
    """A folder of BAM files, each whole and sorted, which follow one another in the genome by their names (K2).

    reads has the fields of SCHEMA but for file and end_; contigs (contig, length_) gives the header's order. Alignments
    without a contig, or of one that contigs does not have, come last as unplaced. Sorting is by ranges of the genome, a
    part has at most part alignments, and a task holds one part; quality and tags may be null. Spark's text writer puts
    out a part's bytes as they are: its line separator is the empty block that ends a BAM file."""
    spark = reads.sparkSession
    names = [(r.contig, r.length_) for r in contigs.select("contig", "length_").collect()]
    text = header_text(names, read_groups, program).encode()
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    head += b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in names)
    order = spark.createDataFrame([(c, k) for k, (c, _) in enumerate(names)], "_c string, _k int")
    numbered = reads
    for column, number in (("contig", "ref"), ("mate_contig", "mate")):
        numbered = numbered.join(order, F.col(column) == F.col("_c"), "left").withColumn(number, F.coalesce("_k", F.lit(-1))).drop("_c", "_k")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    rows = numbered.select("query_name", zero("flag", 0), "ref", zero("start_", -1), zero("mapq", 255), "cigar", "mate", zero("mate_start", -1), zero("isize", 0), "seq", "qual", "tags")
    last = F.col("ref") < 0
    ranges = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), last, "ref", "start_", "query_name").sortWithinPartitions(last, "ref", "start_", "query_name", "flag")
    numeric = frozenset(numeric_tags)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = bytearray(), 0
        for f in batches:
            for r in f.itertuples(index=False):
                held += _encoded(r, numeric)
                n += 1
                if n == part:
                    yield pd.DataFrame({"value": [_blocks(head + bytes(held))]})
                    held, n = bytearray(), 0
        if n:
            yield pd.DataFrame({"value": [_blocks(head + bytes(held))]})

    out = ranges.mapInPandas(work, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.mode("overwrite").option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", _EOF.decode("latin-1")).text(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        found = re.fullmatch(r"part-(\d+)-.*-c(\d+)\.txt", status.getPath().getName())
        if found and status.getLen() <= len(_EOF):
            system.delete(status.getPath(), False)
        elif found:
            system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, f"part-{found[1]}-{found[2]}.bam"))
