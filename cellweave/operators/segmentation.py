"""Copy-number profiles: correction for GC, scaling to integers, circular binary segmentation and clones.

A group is one cell's bins, or one cell's bins of a contig: the genome bounds it, not the number of reads."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lowess(y: np.ndarray, x: np.ndarray, share: float = 2 / 3, rounds: int = 3) -> np.ndarray:
    """Cleveland's robust local regression: the fit at each x. Ties in x get the same fit."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    n = len(x)
    if n < 3 or np.ptp(x) == 0:
        return np.full(n, y.mean() if n else 0.0)
    near, trust = max(2, int(share * n + 1e-10)), np.ones(n)
    places, where = np.unique(x, return_inverse=True)
    fit = np.zeros(n)
    for _ in range(rounds + 1):
        at = np.empty(len(places))
        for k, p in enumerate(places):
            gap = np.abs(x - p)
            reach = max(np.partition(gap, near - 1)[near - 1], 1e-12)
            w = np.clip(1 - (gap / (reach * (1 + 1e-9))) ** 3, 0, None) ** 3 * trust
            total = w.sum()
            if total <= 0:
                at[k] = y.mean()
                continue
            mx, my = (w * x).sum() / total, (w * y).sum() / total
            spread = (w * (x - mx) ** 2).sum()
            at[k] = my + ((w * (x - mx) * (y - my)).sum() / spread * (p - mx) if spread > 1e-12 else 0.0)
        fit = at[where]
        left = np.abs(y - fit)
        scale = 6 * np.median(left)
        if scale <= 0:
            break
        trust = np.clip(1 - (left / scale) ** 2, 0, None) ** 2
    return fit


def gc_corrected(counts: DataFrame, most: float, centre: str = "median") -> DataFrame:
    """(sm, bin, copies): counts (sm, bin, n, gc) over their local regression on gc, from 0 to most, then centred on 2.

    A null gc takes the mean of the cell's other bins. Where the fit is not positive, and in cells with a centre of 0, copies are null."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        gc = f["gc"].astype(float)
        gc = gc.fillna(gc.mean() if gc.notna().any() else 0.5).to_numpy()
        n = f["n"].to_numpy(float)
        fit = lowess(n, gc)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.clip(np.where(fit > 0, n / fit, np.nan), 0, most)
            mid = np.nanmedian(out) if centre == "median" else np.nanmean(out)
            out = out / mid * 2 if mid > 0 else np.full(len(out), np.nan)
        return pd.DataFrame({"sm": f["sm"].to_numpy(), "bin": f["bin"].to_numpy(), "copies": [None if np.isnan(v) else float(v) for v in out]})

    return counts.select("sm", "bin", "n", "gc").groupBy("sm").applyInPandas(one, "sm string, bin long, copies double")


def scale_to_integers(copies: DataFrame, low: float = 0.7, high: float = 1.3, offset: float = 0.01) -> DataFrame:
    """(sm, bin, copies) times a factor and plus an offset of its cell, within bounds, that bring values nearest to integers.

    The cost is the squared distance to integers and thirty times that of the median to 2. A grid finds the valley and
    two finer ones its floor; of equal costs, the smallest factor counts. Null copies stay null."""

    def cost(v: np.ndarray, a: float, b: float) -> float:
        z = v * a + b
        return float(((z - np.round(z)) ** 2).sum() + 30 * (np.median(z) - 2) ** 2)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        all_ = f["copies"].to_numpy(float)
        v = all_[~np.isnan(all_)]
        a, b = 1.0, 0.0
        if len(v):
            wide, tall = (high - low) / 2, offset
            a = (high + low) / 2
            for _ in range(3):
                grid = [(x, y) for x in np.linspace(max(low, a - wide), min(high, a + wide), 61) for y in np.linspace(max(-offset, b - tall), min(offset, b + tall), 5)]
                a, b = min(grid, key=lambda g: (round(cost(v, *g), 12), g))
                wide, tall = wide / 20, tall / 2
        return f.assign(copies=[None if np.isnan(x) else float(x * a + b) for x in all_])

    return copies.select("sm", "bin", "copies").groupBy("sm").applyInPandas(one, "sm string, bin long, copies double")


def arc_statistics(paths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of cumulated sums (from 0): the largest statistic of all arcs, and where that arc begins and ends.

    An arc from i to j has the mean of its k values set against that of the n - k others: |difference| * sqrt(k (n - k) / n),
    which is the two-sample t statistic but for a variance that all arcs share. Arcs, and what they leave at each end,
    have least values at least, or none."""
    n = paths.shape[1] - 1
    total = paths[:, -1:]
    best, begin, end = np.zeros(len(paths)), np.zeros(len(paths), int), np.zeros(len(paths), int)
    for k in range(least, n - least + 1):
        i = np.arange(n - k + 1)
        i = i[((i == 0) | (i >= least)) & ((i + k == n) | (i + k <= n - least))]
        if not len(i):
            continue
        inner = paths[:, i + k] - paths[:, i]
        z = np.abs(inner / k - (total - inner) / (n - k)) * np.sqrt(k * (n - k) / n)
        at = z.argmax(1)
        top = z[np.arange(len(z)), at]
        better = top > best
        best[better], begin[better], end[better] = top[better], i[at[better]], i[at[better]] + k
    return best, begin, end


def breakpoints(x: np.ndarray, shuffles: int, p: float, least: int, seed: int, together: int = 1 << 18) -> list[int]:
    """Where segments start, 0 first. A stretch is cut at the arc of the largest statistic when its permutation p-value,
    (1 + shuffles that reach it) / (1 + shuffles), is p at most; the parts on both sides and the arc go on alone."""
    starts, work = {0}, [(0, len(x))]
    dice = np.random.default_rng(seed)
    while work:
        low, high = work.pop(0)
        n = high - low
        if n < 2 * least:
            continue
        part = x[low:high] - x[low:high].mean()
        path = lambda rows: np.concatenate((np.zeros((len(rows), 1)), np.cumsum(rows, 1)), 1)
        (top,), (i,), (j,) = arc_statistics(path(part[None, :]), least)
        if top <= 1e-12:
            continue
        reached, left = 0, shuffles
        while left and reached + 1 <= p * (1 + shuffles):
            some = min(left, max(1, together // n))
            reached += int((arc_statistics(path(dice.permuted(np.tile(part, (some, 1)), axis=1)), least)[0] >= top - 1e-12).sum())
            left -= some
        if reached + 1 > p * (1 + shuffles):
            continue
        for a, b in ((0, i), (i, j), (j, n)):
            if a < b:
                starts.add(low + a)
                work.append((low + a, low + b))
    return sorted(starts)


def segments(copies: DataFrame, shuffles: int = 1000, p: float = 0.05, least: int = 5, seed: int = 1) -> DataFrame:
    """(sm, contig, segment, start_bin, end_bin, bins, copies, median): each cell's contigs cut into stretches of like copies.

    Bins with null copies are left out. copies is the mean over the segment. The shuffles are seeded by the cell and
    the contig, so a second run of a task gives the same cuts."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("bin", kind="stable")
        x, bins = f["copies"].to_numpy(float), f["bin"].to_numpy()
        sm, contig = f["sm"].iloc[0], f["contig"].iloc[0]
        at = [*breakpoints(x, shuffles, p, least, zlib.crc32(f"{seed}:{sm}:{contig}".encode())), len(x)]
        rows = [(sm, contig, k, int(bins[a]), int(bins[b - 1]), b - a, float(x[a:b].mean()), float(np.median(x[a:b]))) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
        return pd.DataFrame(rows, columns=["sm", "contig", "segment", "start_bin", "end_bin", "bins", "copies", "median"])

    return copies.where("copies is not null").select("sm", "contig", "bin", "copies").groupBy("sm", "contig").applyInPandas(
        one, "sm string, contig string, segment int, start_bin long, end_bin long, bins long, copies double, median double"
    )


def segment_calls(cut: DataFrame) -> DataFrame:
    """(sm, contig, start_bin, end_bin, bins, copy_number): neighbouring segments of the same rounded median are one call."""
    w = Window.partitionBy("sm", "contig").orderBy("segment")
    rows = cut.withColumn("copy_number", F.rint("median").cast("long"))
    rows = rows.withColumn("_new", (~F.col("copy_number").eqNullSafe(F.lag("copy_number").over(w))).cast("int")).withColumn("_g", F.sum("_new").over(w))
    return rows.groupBy("sm", "contig", "_g").agg(F.min("start_bin").alias("start_bin"), F.max("end_bin").alias("end_bin"), F.sum("bins").alias("bins"), F.first("copy_number").alias("copy_number")).drop("_g")


def steady_segments(profile: DataFrame, segments_: DataFrame, limit: float = 0.025, min_cells: int = 5) -> DataFrame:
    """(contig, start_bin, end_bin, variance): segments (contig, start_bin, end_bin) that two copy numbers or more share out among
    the cells, the second with min_cells at least, and in which the cells of either vary by limit at most.

    profile has (sm, contig, bin, copies). A cell's copy number in a segment is its rounded median, its level the mean;
    variance is the larger sample variance of levels of the two commonest copy numbers (of equals, the smaller number)."""
    s = segments_.select(F.col("contig").alias("_c"), "start_bin", "end_bin").distinct()
    rows = profile.where("copies is not null").join(s, (F.col("contig") == F.col("_c")) & F.col("bin").between(F.col("start_bin"), F.col("end_bin")))
    cells = rows.groupBy("contig", "start_bin", "end_bin", "sm").agg(F.rint(F.percentile("copies", 0.5)).cast("long").alias("_cn"), F.avg("copies").alias("_level"))
    n = cells.groupBy("contig", "start_bin", "end_bin", "_cn").agg(F.count("*").alias("_n"), F.var_samp("_level").alias("_v"))
    w = Window.partitionBy("contig", "start_bin", "end_bin").orderBy(F.desc("_n"), "_cn")
    top = n.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    out = top.groupBy("contig", "start_bin", "end_bin").agg(F.max("_v").alias("variance"), F.max(F.when(F.col("_r") == 2, F.col("_n"))).alias("_second"))
    return out.where((F.col("_second") >= min_cells) & (F.col("variance") <= limit)).drop("_second")


def clones(profile: DataFrame, min_cells: int) -> DataFrame:
    """(sm, clone, cells): cells whose rounded copies (sm, contig, bin, copies) are all alike, in groups of min_cells at least.

    A profile is told by a digest of its ordered bins; a clone is named after its first cell."""
    marks = F.array_sort(F.collect_list(F.struct("contig", "bin", F.rint("copies").cast("long").alias("c"))))
    keys = profile.where("copies is not null").groupBy("sm").agg(F.sha2(F.to_json(marks), 256).alias("_k"))
    named = keys.groupBy("_k").agg(F.count("*").alias("cells"), F.min("sm").alias("clone")).where(F.col("cells") >= min_cells)
    return keys.join(named, "_k").select("sm", "clone", "cells")
