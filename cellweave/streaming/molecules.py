"""Molecules over a stream of coordinate-sorted reads, and windowed counts of events.

A read's end stands for event time, one second a base, after all contigs before its own: contigs follow one another on one
axis. A molecule leaves the state when the watermark has passed its span by the cache radius, or its contig, and it is
emitted then; later reads of it begin a new one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellweave.operators.molecules import umi_matches

OUTPUT = "sm string, contig string, is_reverse boolean, molecule long, umi string, fragments int, span_start long, span_end long"
STATE = "molecules string"


def offsets(contigs: list[tuple[str, int]], apart: int) -> dict[str, int]:
    """Where each contig (name, length), in the order of the file, begins on the axis of all."""
    out, at = {}, 0
    for name, length in contigs:
        out[name] = at
        at += length + apart
    return out


def streamed(reads: DataFrame, contigs: list[tuple[str, int]], radius: int = 0, hamming: int = 0, cache: int = 10_000) -> DataFrame:
    """Emitted molecules of a stream with columns sm, contig, is_reverse, site, end_, rx and read_index, sorted by contig (in
    the order of contigs, which is that of the file's header) and coordinate. A contig that is not listed is an error."""
    begin = offsets(contigs, cache)
    where = F.map_from_arrays(F.array(*[F.lit(c) for c in begin]), F.array(*[F.lit(v).cast("long") for v in begin.values()]))
    at = F.coalesce(F.try_element_at(where, F.col("contig")), F.raise_error(F.concat(F.lit("a contig that is not listed: "), F.col("contig"))).cast("long"))
    timed = reads.withColumn("_t", F.timestamp_seconds(at + F.col("end_"))).withWatermark("_t", "0 seconds")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        held = json.loads(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("read_index")
            for p, e, u, r in zip(rows["site"], rows["end_"], rows["rx"], rows["read_index"], strict=True):
                p, e, r, u = int(p), int(e), int(r), u or ""
                for m in held:
                    if min(abs(p - m[1]), abs(p - m[2])) <= radius and umi_matches(u, max(m[4], key=m[4].get), hamming):
                        m[1], m[2], m[3] = min(m[1], p), max(m[2], p), max(m[3], e)
                        m[4][u] = m[4].get(u, 0) + 1
                        break
                else:
                    held.append([r, p, p, e, {u: 1}])
        now = state.getCurrentWatermarkMs() // 1000 - begin[key[1]]  # on the contig's own axis
        gone = [m for m in held if m[3] + cache // 2 <= now]
        held = [m for m in held if m[3] + cache // 2 > now]
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp((begin[key[1]] + max(now + 1, min(m[3] for m in held) + cache // 2)) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(
            [(*key, m[0], max(m[4], key=m[4].get), sum(m[4].values()), m[1], m[2]) for m in gone],
            columns=["sm", "contig", "is_reverse", "molecule", "umi", "fragments", "span_start", "span_end"],
        )

    return timed.groupBy("sm", "contig", "is_reverse").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _timed(events: DataFrame) -> DataFrame:
    """Event time must be a timestamp with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of events by type in windows of their time, with a watermark for what comes late."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
