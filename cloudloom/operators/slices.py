"""Slices with halos, node duplicates, per-node statistics and laser compensation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators.partition import sorted_place

AXES = E.AXES


def square_slices(df: DataFrame, axes: dict[str, tuple[int, str]], halo: int) -> DataFrame:
    """(idx, cells, role): the cell of each row in a grid over two axes (column -> size, name), and the cells whose halo it lies in.

    A row goes to at most three more cells, so the table grows by a bounded factor.
    """
    out = df.select("idx", *axes)
    core = F.lit(True)
    for axis, (size, name) in axes.items():
        own, inside = F.floor(F.col(axis) / size), F.pmod(F.col(axis), F.lit(size))
        near = F.array_compact(F.array(own, F.when(inside < halo, own - 1), F.when(inside >= size - halo, own + 1)))
        out = out.withColumn(name, F.explode(near))
        core = core & (F.col(name) == own)
    return out.select("idx", *(name for _, name in axes.values()), F.when(core, "core").otherwise("pad").alias("role"))


def node_duplicates(df: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``duplicate``: whether an earlier row of its node stands at the same place."""
    w = Window.partitionBy(*AXES).orderBy("idx")
    return df.withColumn("duplicate", F.row_number().over(w) > 1).withColumns({f"n{a}": F.shiftright(F.col(a), bits) for a in AXES})


def tree_order(df: DataFrame, bits: int) -> DataFrame:
    """(idx, direct, place): the first row of every position, those of nodes with at most two rows (coded directly) before the rest, both in address order."""
    node = E.morton(*(F.shiftright(a, bits) for a in AXES))
    first = df.groupBy(*AXES).agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("n")).select("idx", node.alias("node"), E.morton(*AXES).alias("address"), "n")
    few = first.groupBy("node").agg((F.sum("n") <= 2).alias("direct"))
    rows = first.join(few, "node").select("idx", "direct", "address", (~F.col("direct")).cast("int").alias("late"))
    return sorted_place(rows, ["late", "address"]).select("idx", "direct", "place")


def compensate_z(df: DataFrame, lasers: list[tuple[int, int]], tolerance: int) -> DataFrame:
    """``df`` with ``laser``, the one whose plane is nearest to the point (the first of equal ones), and z moved to that plane where it lies within ``tolerance``; ``lasers``: (tangent in 1/1024, height)."""
    r = F.floor(F.sqrt(F.col("x").cast("double") * F.col("x") + F.col("y").cast("double") * F.col("y")))
    rows = df.withColumn("__r", r)
    planes = F.array(*((F.shiftright(F.col("__r") * tangent + 512, 10) + height) for tangent, height in lasers))
    near = F.array_min(F.transform(planes, lambda p, i: F.struct(F.abs(F.col("z") - p).alias("d"), i.alias("laser"), p.alias("plane"))))
    rows = rows.withColumn("__near", near)
    return rows.select(*(c for c in df.columns if c not in ("z", "laser")), F.col("__near.laser").alias("laser"), F.when(F.col("__near.d") <= tolerance, F.col("__near.plane")).otherwise(F.col("z")).cast("int").alias("z"))
