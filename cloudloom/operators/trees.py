"""Prediction trees: chunks of ordered points, each a tree of its own; residuals against ancestors; and their decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators.kernels import nearest_tree
from cloudloom.operators.partition import sorted_place

AXES = E.AXES
#: Orders that points may be put in before they are cut into chunks.
ORDERS = {
    "none": lambda: [F.col("idx").alias("__o")],
    "morton": lambda: [E.morton(*AXES).alias("__o")],
    "radius": lambda: [(F.col("x").cast("bigint") * F.col("x") + F.col("y").cast("bigint") * F.col("y")).alias("__o")],
    "azimuth": lambda: [F.round(F.atan2(F.col("y").cast("double"), F.col("x").cast("double")) * 1024).alias("__o")],
}


def chunks(df: DataFrame, most: int, order: str = "morton") -> DataFrame:
    """``df`` with ``place``, in one of ``ORDERS`` with ties by idx, and ``chunk``: runs of ``most`` places. No task sees more than a chunk of them in what follows."""
    keyed = df.select("*", *ORDERS[order]())
    return sorted_place(keyed, ["__o", "idx"]).drop("__o").withColumn("chunk", F.floor(F.col("place") / most))


def trees(df: DataFrame, most: int = 1024, order: str = "morton") -> DataFrame:
    """(chunk, idx, place, parent, x, y, z): each chunk's tree, every point under the nearest one before it with room; the first has parent -1."""
    cut = chunks(df.select("idx", *AXES), most, order)
    tree = nearest_tree(cut.select("chunk", F.col("place").alias("idx"), *AXES), "chunk").select(F.col("idx").alias("place"), F.col("parent").alias("up"))
    return cut.join(tree, "place").select("chunk", "idx", "place", F.col("up").alias("parent"), *AXES)


def residuals(tree: DataFrame, key: str = "place") -> DataFrame:
    """``tree`` with the mode 0 to 3 and residuals rx, ry, rz of each point against what its ancestors p0, p1, p2 predict: nothing, p0, 2 p0 - p1, or p0 + p1 - p2.

    The mode of the fewest bits is taken, the lowest of equal ones; modes need their ancestors. Ancestors come by self-joins on the point's key, so all points are done at once.
    """
    rows = tree
    up = tree.select(F.col(key).alias("__k"), F.col("parent").alias("__up"), *(F.col(a).cast("bigint").alias(f"__{a}") for a in AXES))
    link = F.col("parent")
    for i in range(3):
        named = up.select(F.col("__k").alias(f"k{i}"), F.col("__up").alias(f"up{i}"), *(F.col(f"__{a}").alias(f"{a}{i}") for a in AXES))
        rows = rows.join(named, link == F.col(f"k{i}"), "left")
        link = F.col(f"up{i}")
    guess = [[F.lit(0)] * 3, [F.col(f"{a}0") for a in AXES], [2 * F.col(f"{a}0") - F.col(f"{a}1") for a in AXES], [F.col(f"{a}0") + F.col(f"{a}1") - F.col(f"{a}2") for a in AXES]]
    tries = []
    for mode, p in enumerate(guess):
        r = [F.col(a) - v for a, v in zip(AXES, p, strict=True)]
        bits = E.code_bits(r[0]) + E.code_bits(r[1]) + E.code_bits(r[2])
        tries.append(F.when(r[0].isNotNull(), F.struct(bits.alias("bits"), F.lit(mode).alias("mode"), *(v.cast("bigint").alias(f"r{a}") for a, v in zip(AXES, r, strict=True)))))
    best = F.array_min(F.array_compact(F.array(*tries)))
    return rows.withColumn("__b", best).select(*tree.columns, F.col("__b.mode").alias("mode"), *(F.col(f"__b.r{a}").alias(f"r{a}") for a in AXES), F.col("__b.bits").alias("bits"))


def decoded(coded: DataFrame) -> DataFrame:
    """(chunk, place, x, y, z) from (chunk, place, parent, mode, rx, ry, rz): ancestors stand before their points, so a chunk is decoded in order of place."""

    def run(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by("place")
        place, parent, mode = (t[c].to_numpy() for c in ("place", "parent", "mode"))
        r = np.stack([t[f"r{a}"].to_numpy() for a in AXES], 1)
        row = {int(p): i for i, p in enumerate(place)}
        up = [row.get(int(p), -1) for p in parent]
        out = np.zeros((len(place), 3), np.int64)
        for i in range(len(place)):
            a = up[i]
            b = up[a] if a >= 0 else -1
            c = up[b] if b >= 0 else -1
            out[i] = r[i] + (0 if mode[i] == 0 else out[a] if mode[i] == 1 else 2 * out[a] - out[b] if mode[i] == 2 else out[a] + out[b] - out[c])
        yield pa.record_batch([pa.array(np.full(len(place), keys[0].as_py())), pa.array(place), *(pa.array(out[:, i]) for i in range(3))], ["chunk", "place", *AXES])

    rows = coded.select(F.col("chunk").cast("long").alias("chunk"), F.col("place").cast("long").alias("place"), F.col("parent").cast("long").alias("parent"), F.col("mode").cast("int").alias("mode"), *(F.col(f"r{a}").cast("long").alias(f"r{a}") for a in AXES))
    return rows.groupBy("chunk").applyInArrow(run, "chunk long, place long, x long, y long, z long")
