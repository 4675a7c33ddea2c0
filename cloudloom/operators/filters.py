"""Predicates and filters on clouds."""

from __future__ import annotations

import math
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E

AXES = E.AXES


def in_box(df: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Rows in an inclusive box; the bounds reach the scan."""
    for a, lo, hi in zip(AXES, low, high, strict=True):
        df = df.filter(F.col(a).between(lo, hi))
    return df


def intersecting(boxes: DataFrame, key: str, margin_x: int = 0, cell: int | None = None) -> DataFrame:
    """Pairs of boxes that share a point, x widened by a margin.

    Boxes go to the cells of x that they span, as wide as the average box, and meet in an equi-join on the cell. A pair that shares several cells is
    kept in the first of them, so nothing needs to be made distinct.
    """
    if cell is None:
        cell = max(1, math.ceil(boxes.agg(F.avg(F.col("max_x") - F.col("min_x") + 1 + margin_x)).first()[0] or 1))
    begin, end = F.floor(F.col("min_x") / cell), F.floor((F.col("max_x") + margin_x) / cell)
    each = boxes.select("*", begin.alias("__begin"), F.explode(F.sequence(begin, end)).alias("__cell"))
    side = lambda n: each.select(F.col(key).alias(n), "__cell", F.col("__begin").alias(f"{n}_begin"), *(F.col(f"{m}_{x}").alias(f"{n}_{m}_{x}") for m in ("min", "max") for x in AXES))
    margin = {"x": margin_x, "y": 0, "z": 0}
    meets = [(F.col(f"a_max_{x}") + margin[x] >= F.col(f"b_min_{x}")) & (F.col(f"a_min_{x}") <= F.col(f"b_max_{x}") + margin[x]) for x in AXES]
    once = F.col("__cell") == F.greatest("a_begin", "b_begin")
    return side("a").join(side("b"), "__cell").filter(fold(lambda p, q: p & q, meets) & once & (F.col("a") < F.col("b"))).select("a", "b")


def crop(df: DataFrame, to: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``df`` inside the bounding box of ``to``, or of its rows of equal ``by``. A box for each value of ``by`` is joined."""
    box = to.groupBy(*by).agg(*(f(x).alias(f"{n}_{x}") for x in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    inside = fold(lambda p, q: p & q, (F.col(x).between(F.col(f"lo_{x}"), F.col(f"hi_{x}")) for x in AXES))
    both = df.join(box, list(by)) if by else df.crossJoin(F.broadcast(box))  # one row
    return both.filter(inside).select(*df.columns)


def is_object(z_bottom: int, z_top: int) -> Column:
    return (F.col("z") < z_bottom) | (F.col("z") > z_top)


def motion_status(motion: DataFrame, translation: int, cosine: int = 65535) -> DataFrame:
    """Whether a frame moves: its rotation or a translation is over the limit."""
    still = (F.col("m00") > cosine) & fold(lambda p, q: p & q, (F.abs(f"t{i}") < translation for i in range(3)))
    return motion.withColumn("moving", ~still)


def direct_mode(df: DataFrame, bits: int) -> DataFrame:
    """Nodes of 2^bits that may be coded directly: at most two points, or all in one place."""
    node = [F.shiftright(F.col(a), bits).alias(f"n{a}") for a in AXES]
    counts = df.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{k}{a}") for a in AXES for k, f in (("lo", F.min), ("hi", F.max))))
    same = fold(lambda p, q: p & q, (F.col(f"lo{a}") == F.col(f"hi{a}") for a in AXES))
    return counts.select("nx", "ny", "nz", "n", ((F.col("n") <= 2) | same).alias("direct"))


def pair_eligible(motion: DataFrame, size: tuple[float, float, float], share: float = 0.001, degrees: float = 0.05) -> DataFrame:
    """``motion`` with ``eligible``: whether a pair of frames is so near that a frame between may use both.

    Each translation must be under ``share`` of the box, and the rotation about each axis, read from the matrix (16 fractional bits), under ``degrees``.
    """
    near = fold(lambda p, q: p & q, (F.abs(f"t{i}") / F.lit(float(size[i])) < share for i in range(3)))
    tangent, sine = math.tan(math.radians(degrees)), math.sin(math.radians(degrees))
    turned = (F.abs(F.col("m12") / F.col("m22")) < tangent) & (F.abs(F.col("m02") / 65536.0) < sine) & (F.abs(F.col("m01") / F.col("m00")) < tangent)
    return motion.withColumn("eligible", near & turned)
