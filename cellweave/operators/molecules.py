"""Molecule assignment: fragments of one molecule share a key, lie near and have UMIs that match.

Without tolerance a molecule is a group of equal keys and UMIs, in built-in aggregation. With it, assignment is greedy
and depends on the order of reads, so the fragments of a key pass through one Arrow function in that order. A key holds
the fragments of one cell, strand and neighbourhood: gaps wider than the reach split it beforehand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.operators.windows import running_max


def exact(fragments: DataFrame, *key: str) -> DataFrame:
    """Adds molecule (smallest read_index), rc (rank in it from 0), af (its fragments) and duplicate."""
    w = Window.partitionBy(*key)
    rc = F.row_number().over(w.orderBy("read_index")) - 1
    return fragments.withColumns({"molecule": F.min("read_index").over(w), "rc": rc, "af": F.count("*").over(w)}).withColumn("is_copy", F.col("rc") > 0)


def near_groups(fragments: DataFrame, key: list[str], position: str, reach: int, end: str | None = None) -> DataFrame:
    """Adds session, the first position of a run of a key in which every fragment begins within reach of what came before.
    Molecules never cross runs. Fragments of one position are of one run, so runs are sought among positions, in windows that span
    tiles of the coordinate; fragments only join what was found."""
    places = fragments.groupBy(*key, position).agg(F.max(F.col(end or position)).alias("_far"))
    rows = running_max(places, "_reach", F.col("_far"), key, [position], True)
    opened = F.when(F.col("_reach").isNull() | (F.col(position) - F.col("_reach") > reach), F.col(position))
    found = running_max(rows, "session", opened, key, [position], False)
    names = [*key, position]
    found = found.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(names)], "session")
    on = F.lit(True)
    for i, c in enumerate(names):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return fragments.join(found, on).drop(*[f"_g{i}" for i in range(len(names))])


def umi_matches(a: str, b: str, most: int) -> bool:
    """Equal, or of equal length with at most so many differing places; N matches anything."""
    if a == b:
        return True
    return len(a) == len(b) and sum(x != y and x != "N" and y != "N" for x, y in zip(a, b, strict=True)) <= most


def first_seen(counts: dict, a: str, b: str) -> bool:
    """Whether a came before b into the counts."""
    return next(k for k in counts if k in (a, b)) == a


def assign(
    fragments: DataFrame, key: list[str], position: str = "site", umi: str | None = "rx", radius: int = 0, hamming: int = 0, pooling: int = 1, most: int | None = None, end: str | None = None
) -> DataFrame:
    """(read_index, molecule, rc, overflow): each fragment joins the first molecule that accepts it, else founds one.

    A fragment is a position, or a span from position to end. It is near when either of its edges lies within the radius of
    the same edge. pooling 1 compares with the edges of the molecule's running span and its commonest UMI (the first seen of
    equals), pooling 0 with any member. Without umi all match. A molecule of most fragments accepts no more, and what it would have accepted overflows into a molecule
    of its own. Order is that of read_index."""
    # with pooling, chains of members can reach further than the radius, never further than one gap at a time
    grouped = near_groups(fragments, key, position, radius, end).select(
        *key, "session", F.col(position).cast("long").alias("_p"), F.col(end or position).cast("long").alias("_e"),
        (F.coalesce(umi, F.lit("")) if umi else F.lit("")).alias("_u"), F.col("read_index").cast("long"),
    )

    names = [*key, "session"]
    # Molecules lie in buckets by the edges that a fragment may be near to: only those of its own bucket and the two beside it are asked.
    width = radius + 1

    def run(batches):
        last, found = None, []
        starts: dict[int, set[int]] = {}
        ends: dict[int, set[int]] = {}
        for pdf in batches:
            rows = []
            for *k, p, e, u, r in pdf[[*names, "_p", "_e", "_u", "read_index"]].itertuples(index=False, name=None):
                if k != last:
                    last, found, starts, ends = k, [], {}, {}
                home, full = None, False
                at, to = p // width, e // width
                near_by = set().union(*(x.get(b + d, ()) for x, b in ((starts, at), (ends, to)) for d in (-1, 0, 1)))
                for m in map(found.__getitem__, sorted(near_by)):
                    if pooling:
                        near = min(abs(p - m["low"]), abs(e - m["high"])) <= radius
                        ok = near and umi_matches(u, m["mode"], hamming)
                    else:
                        ok = any(min(abs(p - q), abs(e - z)) <= radius and umi_matches(u, v, hamming) for q, z, v in m["members"])
                    if ok:
                        full = most is not None and m["n"] >= most
                        home = None if full else m
                        break
                if home is None:
                    home = {"id": r, "low": p, "high": e, "umis": {}, "mode": u, "members": set(), "n": 0, "k": len(found)}
                    if not full:
                        found.append(home)
                        starts.setdefault(at, set()).add(home["k"])
                        ends.setdefault(to, set()).add(home["k"])
                elif pooling:
                    if p < home["low"] and at != home["low"] // width:
                        starts[home["low"] // width].discard(home["k"])
                        starts.setdefault(at, set()).add(home["k"])
                    if e > home["high"] and to != home["high"] // width:
                        ends[home["high"] // width].discard(home["k"])
                        ends.setdefault(to, set()).add(home["k"])
                else:
                    starts.setdefault(at, set()).add(home["k"])
                    ends.setdefault(to, set()).add(home["k"])
                rows.append((r, home["id"], home["n"], full))
                home["low"], home["high"], home["n"] = min(home["low"], p), max(home["high"], e), home["n"] + 1
                home["umis"][u] = home["umis"].get(u, 0) + 1
                if home["umis"][u] > home["umis"][home["mode"]] or (home["umis"][u] == home["umis"][home["mode"]] and first_seen(home["umis"], u, home["mode"])):
                    home["mode"] = u
                if not pooling:
                    home["members"].add((p, e, u))
            yield pd.DataFrame(rows, columns=["read_index", "molecule", "rc", "overflow"]).astype({"read_index": "int64", "molecule": "int64", "rc": "int32", "overflow": "bool"})

    # One sorted pass over many keys: Spark's sort spills, and the worker holds the molecules of one session only.
    dealt = grouped.repartition(*names).sortWithinPartitions(*names, "read_index")
    return dealt.mapInPandas(run, "read_index long, molecule long, rc int, overflow boolean")


def molecules(fragments: DataFrame, *key: str) -> DataFrame:
    """One row a molecule: fragments, span, mean and largest mapq, consensus site (smallest forward, largest reverse)."""
    site = F.when(F.first("is_reverse"), F.max("site")).otherwise(F.min("site"))
    return fragments.groupBy(*key).agg(
        F.count("*").alias("fragments"), F.min("start_").alias("span_start"), F.max("end_").alias("span_end"), F.max("mapq").alias("max_mapq"), site.alias("consensus_site"),
        F.min("read_index").alias("molecule"),
    )


def valid(min_fragments: int = 1, min_mapq: int = 0, max_span: int | None = None):
    """A Column over molecules: enough fragments, mapped well enough, no wider than max_span."""
    out = (F.col("fragments") >= min_fragments) & (F.col("max_mapq") >= min_mapq)
    return out if max_span is None else out & (F.col("span_end") - F.col("span_start") <= max_span)


def rejection():
    return F.when(F.col("max_mapq") == 0, "multimapping").when(F.col("max_mapq") < 20, "MQ")


def most_common(fragments: DataFrame, value: str, *key: str) -> DataFrame:
    """The commonest value of each key; of equals, the one first seen."""
    n = fragments.groupBy(*key, value).agg(F.count("*").alias("n"), F.min("read_index").alias("first"))
    return n.groupBy(*key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def duplication_rate(reads: DataFrame, *by: str) -> DataFrame:
    return reads.groupBy(*by).agg((F.count("*") / F.nullif(F.sum((~F.col("duplicate")).cast("int")), F.lit(0))).alias("rate"))


def reactions(fragments: DataFrame, molecule: list[str], primer: list[str]) -> DataFrame:
    """Numbers of a molecule's random-primer reactions (rt) and of a fragment within one (rd)."""
    rt = F.dense_rank().over(Window.partitionBy(*molecule).orderBy(*primer)) - 1
    rd = F.row_number().over(Window.partitionBy(*molecule, *primer).orderBy("read_index")) - 1
    return fragments.withColumns({"rt": rt, "rd": rd})


def filtered(
    molecules_: DataFrame, fragments: tuple[int | None, int | None] = (None, None), mapq: tuple[int | None, int | None] = (None, None), reactions_: tuple[int | None, int | None] = (None, None),
    span: tuple[int | None, int | None] = (None, None), both_mates: bool = False,
) -> DataFrame:
    """Molecules whose columns fragments, max_mapq, reactions and span lie between bounds (None: no bound), with a fragment of two
    mates (column has_both) where asked. A null fails every bound."""
    keep = F.lit(True)
    for column, (low, high) in (("fragments", fragments), ("max_mapq", mapq), ("reactions", reactions_), ("span", span)):
        if low is not None:
            keep = keep & (F.col(column) >= low)
        if high is not None:
            keep = keep & (F.col(column) <= high)
    return molecules_.where(keep & F.col("has_both") if both_mates else keep)
