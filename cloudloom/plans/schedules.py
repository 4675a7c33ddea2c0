"""Coding orders of a group of frames, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hierarchical(first: int, last: int, step: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(code order, frame, two references, QP shift) of the frames between two anchors, each midpoint before its halves.

    A frame's shift is one step more than the larger shift of its references; anchors have none.
    """
    out: list[tuple[int, int, int, int, int]] = []
    pending = [(first, last, 0, 0)]
    while pending:
        low, high, low_shift, high_shift = pending.pop()
        if high - low < 2:
            continue
        middle, shift = (low + high) // 2, max(low_shift, high_shift) + step
        out.append((len(out), middle, low, high, shift))
        pending += [(middle, high, shift, high_shift), (low, middle, low_shift, shift)]
    return out


def reference_counts(rows: list[tuple[int, int, int, int, int]]) -> dict[int, int]:
    """How many frames still need each frame: at 0 it can leave the reorder buffer."""
    counts: dict[int, int] = {}
    for _, _, a, b, _ in rows:
        counts[a] = counts.get(a, 0) + 1
        counts[b] = counts.get(b, 0) + 1
    return counts


def output_times(schedule: DataFrame) -> DataFrame:
    """(frame, decoded, output, evicted) of a reorder buffer over a table (code_order, frame, ref0, ref1): a frame is put out once all frames
    before it are decoded, and leaves the buffer when it is out and no frame still to decode refers to it. Anchors that are only referred to are decoded at -1.

    A schedule is a small table; the windows see it whole.
    """
    refs = schedule.select(F.explode(F.array("ref0", "ref1")).alias("frame"), "code_order").groupBy("frame").agg(F.max("code_order").alias("last"))
    every = schedule.select("frame", "code_order").join(refs, "frame", "full").select("frame", F.coalesce("code_order", F.lit(-1)).cast("long").alias("decoded"), "last")
    out = F.max("decoded").over(Window.partitionBy(F.lit(0)).orderBy("frame"))
    return every.select("frame", "decoded", out.alias("output"), F.greatest(out, F.coalesce("last", F.lit(-1))).alias("evicted"))
