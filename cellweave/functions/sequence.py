"""Scalar functions over sequences, qualities, CIGAR strings and headers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC complement used throughout.
_FROM, _TO = "ATCGNatcgn", "TAGCNtagcn"


def complement(seq: Column) -> Column:
    return F.translate(seq, _FROM, _TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def gc_ratio(seq: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, F.length(F.regexp_replace(seq, "[^GCgc]", "")) / n)


def hamming(a: Column, b: Column) -> Column:
    """Mismatches over the shorter length; N on either side never counts."""
    pairs = F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    differs = lambda p: p["a"].isNotNull() & p["b"].isNotNull() & (p["a"] != "N") & (p["b"] != "N") & (p["a"] != p["b"])
    return F.size(F.filter(pairs, differs))


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """Edit distance, null where it is over most."""
    d = F.levenshtein(a, b, most)
    return F.when(d >= 0, d)


def phred_to_probability(q: Column) -> Column:
    """Chance that a base of an ASCII phred+33 character is wrong."""
    return F.pow(F.lit(10.0), -(F.ascii(q) - 33) / 10.0)


def probability_to_phred(p: Column) -> Column:
    """Phred of the chance of being right, rounded, 0 to 60."""
    return F.greatest(F.lit(0), F.least(F.lit(60), F.rint(-10 * F.log10(F.greatest(1 - p, F.lit(1e-12)))).cast("int")))


def cigar_total(cigar: Column, operations: str) -> Column:
    """Summed length of the operations of a CIGAR string."""
    found = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{operations}]"), F.lit(1))
    return F.coalesce(F.aggregate(found, F.lit(0), lambda t, x: t + x.cast("int")), F.lit(0))


def leading_clip(cigar: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(cigar, r"^(\d+)S", 1), F.lit("")).cast("int"), F.lit(0))


def trailing_clip(cigar: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(cigar, r"(\d+)S$", 1), F.lit("")).cast("int"), F.lit(0))


def soft_clip_ratio(cigar: Column) -> Column:
    """S over S plus M; 1.1 without a CIGAR, so that a limit of one rejects it."""
    s, m = cigar_total(cigar, "S"), cigar_total(cigar, "M")
    return F.when(cigar.isNull() | (s + m == 0), 1.1).otherwise(s / (s + m))


def safe_text(c: Column) -> Column:
    """What may stand in a FASTQ header."""
    return F.regexp_replace(c, r"[^a-zA-Z0-9\-_.]", "")


def split_nth(c: Column, by: str, n: int) -> tuple[Column, Column]:
    """The text before and after the n-th separator."""
    head = F.substring_index(c, by, n)
    return head, F.substr(c, F.length(head) + len(by) + 1)


def homopolymer(seq: Column, length: int) -> Column:
    return seq.rlike(rf"([ACGT])\1{{{length - 1}}}")


def decoded_tags(name: Column) -> Column:
    """The tag map of a read name of the form k:v;k:v."""
    return F.str_to_map(name, F.lit(";"), F.lit(":"))


def trim_poly_tail(seq: Column) -> Column:
    """Cut at the first run of ten A, then at that of ten G, strip trailing G and A, and drop three more bases."""
    s = F.regexp_replace(seq, "A{10}.*$", "")
    s = F.regexp_replace(s, "G{10}.*$", "")
    s = F.regexp_replace(s, "[GA]*$", "")
    return F.substr(s, F.lit(1), F.greatest(F.length(s) - 3, F.lit(0)))


def substitution_class(ref: Column, alt: Column, before: Column, after: Column) -> Column:
    """Trinucleotide substitution, collapsed on pyrimidines: A[C>T]G."""
    flip = ref.isin("A", "G")
    left, right = F.when(flip, complement(after)).otherwise(before), F.when(flip, complement(before)).otherwise(after)
    return F.concat(left, F.lit("["), F.when(flip, complement(ref)).otherwise(ref), F.lit(">"), F.when(flip, complement(alt)).otherwise(alt), F.lit("]"), right)


def taps_context(ref3: Column, observed: Column, forward: Column) -> Column:
    """z/Z CpG, x/X CHG, h/H CHH of a trinucleotide that starts at the cytosine (already on its strand); upper case where the
    conversion shows a methylated base; '.' elsewhere."""
    two = [a + b for a in "ACT" for b in "ACT"]
    kind = F.when(F.substring(ref3, 1, 2) == "CG", "z").when(F.substring(ref3, 1, 3).isin("CAG", "CCG", "CTG"), "x").when(F.substring(ref3, 1, 3).isin([f"C{x}" for x in two]), "h")
    converted = F.when(forward, observed == "T").otherwise(observed == "A")
    plain = F.when(forward, observed == "C").otherwise(observed == "G")
    return F.coalesce(F.when(converted, F.upper(kind)).when(plain, kind), F.lit("."))


def md_tag(ref: Column, seq: Column) -> Column:
    """The MD string of two sequences of aligned bases: numbers of equal bases between the reference bases that differ; no zeros."""
    marks = F.zip_with(F.split(F.upper(ref), ""), F.split(seq, ""), lambda a, b: F.when(a == "", "").when(a == b, "=").otherwise(a))
    text = F.array_join(marks, "")
    runs = F.regexp_extract_all(text, F.lit("(=+|[^=])"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.startswith("="), F.length(x).cast("string")).otherwise(x)), "")


def valid_file_name(c: Column) -> Column:
    """What may stand in a file name: spaces become underscores, other signs go."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), " ", "_"), r"[^\w\-.]", "")


# The letters that stand for qualities 0 to 51 in a header.
_QUALITY_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_QUALITY_SIGNS = "".join(chr(33 + i) for i in range(len(_QUALITY_LETTERS)))


def qualities_to_letters(q: Column) -> Column:
    """Phred+33 qualities as letters that a header can hold; what is over the last letter's quality is that letter."""
    beyond = "".join(chr(33 + i) for i in range(len(_QUALITY_LETTERS), 94))
    return F.translate(q, _QUALITY_SIGNS + beyond, _QUALITY_LETTERS + _QUALITY_LETTERS[-1] * len(beyond))


def letters_to_qualities(c: Column) -> Column:
    return F.translate(c, _QUALITY_LETTERS, _QUALITY_SIGNS)


def differing_places(a: Column, b: Column) -> Column:
    """Places, from 0, at which two sequences differ, over the shorter length."""
    pairs = F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    each = F.transform(pairs, lambda p, i: F.when(p["a"].isNotNull() & p["b"].isNotNull() & (p["a"] != p["b"]), i))
    return F.filter(each, lambda i: i.isNotNull())


def file_type(path: Column) -> Column:
    """fa, gtf, bed, vcf, bam, fastq or unknown, by a path's ending; a .gz at its end does not count."""
    name, out = F.regexp_replace(F.lower(path), r"\.gz$", ""), F.lit("unknown")
    for kind, ends in (("fastq", r"\.(fastq|fq)$"), ("bam", r"\.bam$"), ("vcf", r"\.vcf$"), ("bed", r"\.bed$"), ("gtf", r"\.(gtf|gff3?)$"), ("fa", r"\.(fa|fasta)$")):
        out = F.when(name.rlike(ends), kind).otherwise(out)
    return out


def base_in_context(context: Column, base: Column) -> Column:
    """A context of odd length with another base in its middle."""
    k = ((F.length(context) - 1) / 2).cast("int")
    return F.concat(F.substr(context, F.lit(1), k), base, F.substr(context, k + 2))


def inverted_strand(strand: Column) -> Column:
    return F.when(strand == "+", "-").when(strand == "-", "+").otherwise(".")


def cell_name(name: Column) -> Column:
    """(replicate, passage, plate, cell) of a cell's name, 'replicate_passage_plate_cellN' or 'replicate-Ppassage-plate_cellN'.

    In the second form a plate loses its letters s and the mark NLAP, and L in it stands for a dash; names with APKS1P25 are
    replicate APKS1 at passage 25, with a dash between the letters of their plate."""
    under, dash = F.split(name, "_"), F.split(F.split_part(name, F.lit("_"), F.lit(1)), "-")
    of = lambda r, p, l, c: F.struct(r.alias("replicate"), p.try_cast("int").alias("passage"), l.alias("plate"), c.try_cast("int").alias("cell"))  # noqa: E731, E741
    old = name.contains("APKS1P25")
    letters = F.array_join(F.filter(F.split(F.regexp_replace(F.get(dash, F.lit(1)), "NLAP|L|s", ""), ""), lambda c: c != ""), "-")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.array_join(F.slice(dash, 3, 1000), "-"), "s", ""), "NLAP", ""), "L", "-")
    cell = F.when(name.contains("cell"), F.substring_index(name, "cell", -1)).otherwise(F.substring_index(name, "_", -1))
    plain = of(F.get(dash, F.lit(0)), F.regexp_replace(F.get(dash, F.lit(1)), "P", ""), rest, cell)
    parts = [F.get(under, F.lit(k)) for k in range(4)]
    return F.when(F.size(under) == 4, of(parts[0], parts[1], parts[2], F.regexp_replace(parts[3], "cell", ""))).when(old, of(F.lit("APKS1"), F.lit("25"), letters, cell)).otherwise(plain)
