"""Levels of detail, predictor weights and the lifting transform."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators.joins import knn_join
from cloudloom.operators.partition import sorted_place
from cloudloom.sources.shared import staged

AXES = E.AXES


def centroid_sample(df: DataFrame, bits: int, backward: bool = False) -> DataFrame:
    """The point of each cell of 2^(bits+1) that lies nearest (L1) to the cell's centroid, times its count; ties to the first in Morton order, or the last when ``backward``.

    Positions are cut to 2^bits first. Two shuffles on the cell, both of sums.
    """
    cell = {f"c{a}": F.shiftright(F.col(a), bits + 1) for a in AXES}
    cut = {f"p{a}": F.shiftleft(F.shiftright(F.col(a), bits), bits).cast("bigint") for a in AXES}
    rows = df.withColumns(cell | cut | {"__m": E.morton(*AXES)})
    sums = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), *(F.sum(p).alias(f"s{p}") for p in cut))
    far = sum((F.abs(F.col(p) * F.col("__n") - F.col(f"s{p}")) for p in list(cut)[1:]), F.abs(F.col("px") * F.col("__n") - F.col("spx")))
    order = F.struct(far.alias("d"), (-F.col("__m") if backward else F.col("__m")).alias("m"), (-F.col("idx") if backward else F.col("idx")).alias("i"))
    return rows.join(sums, list(cell)).groupBy(*cell).agg(F.min_by("idx", order).alias("idx"), F.count(F.lit(1)).alias("n"))


def predictor_weights(edges: DataFrame, fixed_bits: int = 8) -> DataFrame:
    """(idx, n, w0, w1, w2) of inverse-distance weights in fixed point, over (t, d2, rank) edges of at most three neighbours.

    Distances over the fixed range lose low bits, half up; neighbours 2^bits times further than the first are dropped from
    the end; quotients come from the reciprocal table's rule. Weights of a point add up to 2^bits.
    """
    one = F.lit(1 << fixed_bits).cast("bigint")
    d = edges.groupBy("t").agg(*(F.max(F.when(F.col("rank") == i + 1, F.col("d2"))).alias(f"d{i}") for i in range(3)))
    drop = F.greatest(F.lit(0), F.when(F.col("d0") > 0, E.ilog2(F.col("d0")) - (fixed_bits - 1)).otherwise(0))
    half = F.call_function("shiftright", F.call_function("shiftleft", F.lit(1).cast("bigint"), drop), F.lit(1))
    d = d.select("t", *(F.call_function("shiftright", F.col(f"d{i}") + half, drop).alias(f"d{i}") for i in range(3)))
    limit = F.col("d0") * one
    two = F.col("d1").isNotNull() & (F.col("d1") < limit)
    three = F.col("d2").isNotNull() & (F.col("d2") < limit)
    n = F.when(three, 3).when(two, 2).otherwise(1)
    a, b, c = (F.coalesce(F.col(f"d{i}"), F.lit(0)).cast("bigint") for i in range(3))
    pair = E.div_approx(a, F.greatest(a + b, F.lit(1)), fixed_bits)
    total = F.greatest(b * c + a * c + a * b, F.lit(1))
    w2, w1 = E.div_approx(a * b, total, fixed_bits), E.div_approx(a * c, total, fixed_bits)
    return d.select(F.col("t").alias("idx"), n.alias("n"), F.when(n == 3, one - w1 - w2).when(n == 2, one - pair).otherwise(one).alias("w0"), F.when(n == 3, w1).when(n == 2, pair).otherwise(0).cast("bigint").alias("w1"), F.when(n == 3, w2).otherwise(0).cast("bigint").alias("w2"))


def blended_weights(w: tuple[Column, Column, Column], d01: Column, d02: Column, d12: Column) -> list[Column]:
    """Weights of three neighbours mixed by how near they are to each other; they still add up to 256."""
    near, far = 1, 5
    b1 = F.when(d01 <= d02, near).otherwise(far)
    b2 = F.when(d01 <= d12, far).otherwise(near)
    b3 = F.when(d02 <= d12, near).otherwise(far)
    first = F.shiftright(w[0] * 10 + w[1] * (6 - b2) + w[2] * b3, 4)
    second = F.shiftright(w[0] * b1 + w[1] * 10 + w[2] * (6 - b3), 4)
    return [first, second, F.lit(256) - first - second]


def levels(df: DataFrame, period: int = 4, most_levels: int = 12) -> DataFrame:
    """(idx, place, lod) by repeated decimation in Morton order: 0 is the coarsest.

    Keeping every ``period``-th of what the last level kept keeps the places divisible by a power of the period,
    so one range sort gives all levels; nothing is looped over.
    """
    placed = sorted_place(df.withColumn("__m", E.morton(*AXES)), ["__m", "idx"]).drop("__m")
    kept = F.lit(0)
    for k in range(1, most_levels):
        kept = kept + (F.col("place") % F.lit(period**k) == 0).cast("int")
    return placed.withColumn("lod", F.lit(most_levels - 1) - kept)


def lifting(df: DataFrame, attribute: str, period: int = 4, most_levels: int = 6, neighbours: int = 3) -> tuple[DataFrame, DataFrame]:
    """(coefficients, edges) of the lifting transform of ``attribute``: predict from coarser levels, update them, level by level.

    ``coefficients`` is (idx, lod, value), ``edges`` (t, s, lod, weight) what the inverse needs. All of a level is
    done at once: its neighbours are coarser.
    """
    cloud = staged(levels(df, period, most_levels), "lod")
    state = cloud.select("idx", "lod", F.col(attribute).cast("bigint").alias("value"))
    edges: DataFrame | None = None
    for level in range(most_levels - 1, 0, -1):
        fine, coarse = cloud.filter(F.col("lod") == level), cloud.filter(F.col("lod") < level)
        if fine.isEmpty() or coarse.isEmpty():
            continue
        near = knn_join(fine.select("idx", *AXES), coarse.select("idx", *AXES), neighbours)
        near = staged(near, "edges")
        w = predictor_weights(near)
        each = near.join(w, near.t == w.idx).filter(F.col("rank") <= F.col("n")).select("t", "s", F.lit(level).alias("lod"), F.when(F.col("rank") == 1, F.col("w0")).when(F.col("rank") == 2, F.col("w1")).otherwise(F.col("w2")).alias("weight"))
        each = staged(each, "weights")
        edges = each if edges is None else edges.unionByName(each)
        state = staged(_lift(state, each, level, forward=True), "lift")
    if edges is None:
        edges = cloud.sparkSession.createDataFrame([], "t long, s long, lod int, weight long")
    return state, edges


def inverse_lifting(coefficients: DataFrame, edges: DataFrame) -> DataFrame:
    """Values from ``lifting``'s coefficients: update, then predict, from the coarsest level up. Exact."""
    state = coefficients
    top = edges.agg(F.max("lod")).first()[0] or 0
    for level in range(1, top + 1):
        state = staged(_lift(state, edges.filter(F.col("lod") == level), level, forward=False), "unlift")
    return state


def _lift(state: DataFrame, edges: DataFrame, level: int, forward: bool) -> DataFrame:
    sign = 1 if forward else -1

    def predict(s: DataFrame) -> DataFrame:
        seen = edges.join(s.select(F.col("idx").alias("s"), "value"), "s").groupBy("t").agg(E.shift_half_away(F.sum(F.col("weight") * F.col("value")), 8).alias("p"))
        return s.join(seen.withColumnRenamed("t", "idx"), "idx", "left").select("idx", "lod", (F.col("value") - sign * F.coalesce("p", F.lit(0))).alias("value"))

    def update(s: DataFrame) -> DataFrame:
        got = edges.join(s.select(F.col("idx").alias("t"), "value"), "t").groupBy("s").agg(F.sum(F.col("weight") * F.col("value")).alias("a"), F.sum("weight").alias("w"))
        half = got.select(F.col("s").alias("idx"), F.when(F.col("w") > 0, E.idiv(F.col("a"), F.greatest(F.col("w"), F.lit(1)) * 2)).otherwise(0).alias("u"))
        return s.join(half, "idx", "left").select("idx", "lod", (F.col("value") + sign * F.coalesce("u", F.lit(0))).alias("value"))

    return update(predict(state)) if forward else predict(update(state))


def distance_sample(df: DataFrame, slice_col: str, bits: int) -> DataFrame:
    """(slice, idx) kept greedily in Morton order: a point is kept if no point already kept lies within 3 * 4^bits of squared distance.

    What is kept depends on what was, so each slice is one task's stream; a grid of the kept points
    makes a point look at 27 cells only.
    """
    limit, width = 3 * 4**bits, max(1, 2 << bits)

    def greedy(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by([("m", "ascending"), ("idx", "ascending")]).to_pylist()
        grid: dict[tuple, list[tuple]] = {}
        kept = []
        for r in rows:
            p = (r["x"], r["y"], r["z"])
            c = tuple(v // width for v in p)
            near = (q for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) for q in grid.get((c[0] + i, c[1] + j, c[2] + k), ()))
            if all(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) > limit for q in near):
                grid.setdefault(c, []).append(p)
                kept.append(r["idx"])
        yield pa.record_batch([pa.array([key[0].as_py()] * len(kept), pa.string()), pa.array(kept, pa.int64())], ["slice", "idx"])

    rows = df.select(F.col(slice_col).cast("string").alias("slice"), F.col("idx").cast("long").alias("idx"), *AXES, E.morton(*AXES).alias("m"))
    return rows.groupBy("slice").applyInArrow(greedy, "slice string, idx long")


def sampled(df: DataFrame, method: str, **options) -> DataFrame:
    """(idx): the points that one level of a method keeps: ``distance`` (greedy, by slice), ``period`` (every n-th in Morton order), or ``centroid`` (one a cell)."""
    if method == "distance":
        return distance_sample(df, options["slice_col"], options["bits"]).select("idx")
    if method == "period":
        return levels(df, options["period"], 2).filter("lod = 0").select("idx")
    if method == "centroid":
        return centroid_sample(df, options["bits"]).select("idx")
    raise ValueError(f"no sampling method {method}")


class LevelCache:
    """Levels of a cloud that were built lately, by the cloud's name and the parameters they were built with: equal ones are read again, not built."""

    def __init__(self, most: int = 8):
        self.most, self.held = most, {}

    def levels(self, name: str, df: DataFrame, period: int = 4, most_levels: int = 12) -> DataFrame:
        key = (name, period, most_levels)
        if key not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            self.held[key] = staged(levels(df, period, most_levels), "levels")
        return self.held[key]
