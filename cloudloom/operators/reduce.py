"""Aggregates on clouds: boxes, de-duplication, histograms, metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.sources.shared import staged

AXES = E.AXES


def bounding_box(df: DataFrame, *keys: str) -> DataFrame:
    aggs = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def reduce_points(df: DataFrame, keys: dict[str, Column], values: dict[str, Column], order: str = "idx") -> DataFrame:
    """Groups by the key expressions and projects each group's first row in ``order``: the extension point for any de-duplication.

    Gives the keys, the values of the representative, its ``order`` and the group's size.
    """
    first = F.struct(F.col(order), *(v.alias(n) for n, v in values.items()))
    grouped = df.groupBy(*(k.alias(n) for n, k in keys.items())).agg(F.min_by(first, F.col(order)).alias("__r"), F.count(F.lit(1)).alias("n_src"))
    return grouped.select(*keys, "__r.*", "n_src")


def quantise_dedup(df: DataFrame, scale: float) -> DataFrame:
    """One row for each quantised position, with the number of rows in it."""
    return df.groupBy(*(E.quantise(a, scale).alias(a) for a in AXES)).agg(F.count(F.lit(1)).alias("n_src"))


def level_counts(df: DataFrame, levels: int) -> DataFrame:
    """(level, nodes, points): occupied nodes and points of each octree level, from one range sort of the addresses.

    Two addresses that follow each other part at the level of their highest differing bit, and make two nodes at every level up to it. So
    each range counts its steps by that level, tells its first and last address, and the rows of all ranges give the nodes of all levels.
    """
    spark = df.sparkSession
    codes = staged(df.groupBy(E.morton(*AXES).alias("m")).agg(F.count(F.lit(1)).alias("n")), "addresses")
    points = codes.agg(F.sum("n")).first()[0]
    if not points:
        return spark.createDataFrame([], "level int, nodes long, points long")

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, counts = None, None, np.zeros(22, np.int64)
        for batch in batches:
            m = batch.column(0).to_numpy()
            if not len(m):
                continue
            row = m if last is None else np.concatenate(([last], m))
            first = int(m[0]) if first is None else first
            counts += np.bincount(parting(row[1:] ^ row[:-1]), minlength=22)
            last = int(m[-1])
        if first is not None:
            yield pa.record_batch([pa.array([first]), pa.array([last]), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["first", "last", "counts"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = codes.select("m").repartitionByRange(n, "m").sortWithinPartitions("m").mapInArrow(steps, "first long, last long, counts array<long>")
    rows = sorted(ranges.collect())  # a row for each range
    total = np.sum([r["counts"] for r in rows], axis=0)
    for a, b in zip(rows, rows[1:], strict=False):
        total[parting(np.array([a["last"] ^ b["first"]]))[0]] += 1
    nodes = 1 + total[::-1].cumsum()[::-1]
    return spark.createDataFrame([(k, int(nodes[k]), points) for k in range(levels)], "level int, nodes long, points long")


def parting(gaps: np.ndarray) -> np.ndarray:
    """The octree level of the highest bit of each difference of two addresses."""
    bits = np.zeros(len(gaps), np.int64)
    rest = gaps.astype(np.int64)
    for k in (32, 16, 8, 4, 2, 1):
        big = rest >> k > 0
        bits += np.where(big, k, 0)
        rest = np.where(big, rest >> k, rest)
    return bits // 3


def occupancy(df: DataFrame, levels: Sequence[int], by: tuple[str, ...] = ()) -> DataFrame:
    """The child occupancy byte of each node: bit 4x + 2y + z of the child."""
    bits = F.array(*map(F.lit, levels))
    each = df.select(*by, *AXES, F.explode(bits).alias("level"))
    child = F.expr("4 * (shiftright(x, level) & 1) + 2 * (shiftright(y, level) & 1) + (shiftright(z, level) & 1)")
    node = [F.expr(f"shiftright({a}, level + 1)").alias(f"n{a}") for a in AXES]
    return each.select(*by, "level", *node, child.alias("child")).groupBy(*by, "level", "nx", "ny", "nz").agg(F.bit_or(F.expr("shiftleft(1, child)")).alias("occupancy"))


def mispredicts(df: DataFrame, levels: Sequence[int], frame: str = "frame") -> DataFrame:
    """(frame, level, nodes, missed): children that differ between each frame and the one before it, over the nodes of either."""
    own = occupancy(df, levels, (frame,))
    before = own.withColumn(frame, F.col(frame) + 1).withColumnRenamed("occupancy", "predicted")
    both = own.join(before, [frame, "level", "nx", "ny", "nz"], "full")
    wrong = F.bit_count(F.coalesce("occupancy", F.lit(0)).bitwiseXOR(F.coalesce("predicted", F.lit(0))))
    return both.groupBy(frame, "level").agg(F.count(F.lit(1)).alias("nodes"), F.sum(wrong).alias("missed"))


def histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    return df.groupBy(E.idiv(F.col(column), width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_moments(hist: DataFrame, spread: float = 1.0) -> DataFrame:
    """Mean, variance, mode and mean -+ spread * sigma of a (bin, n) table."""
    sums = hist.agg(F.sum("n").alias("t"), F.sum(F.col("bin") * F.col("n")).alias("s"), F.sum(F.col("bin") * F.col("bin") * F.col("n")).alias("q"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("mode"))
    mean = F.col("s") / F.col("t")
    var = F.col("q") / F.col("t") - mean * mean
    return sums.select(F.col("t").alias("n"), mean.alias("mean"), var.alias("variance"), "mode", (mean - spread * F.sqrt(var)).alias("low"), (mean + spread * F.sqrt(var)).alias("high"))


def density_thresholds(nodes: DataFrame, shares: tuple[float, float] = (0.05, 0.6)) -> DataFrame:
    """Node sizes at which the running share of points first passes each limit, over a (n) table of nodes.

    Nodes are first counted by size: sizes are few next to nodes, so the running sum sees a small table.
    """
    by = nodes.groupBy("n").agg(F.count(F.lit(1)).alias("nodes"))
    w = Window.partitionBy(F.lit(0)).orderBy("n")
    total = F.sum(F.col("n") * F.col("nodes")).over(Window.partitionBy(F.lit(0)))
    before = F.sum(F.col("n") * F.col("nodes")).over(w)
    ranked = by.select("n", (before / total).alias("share"))
    return ranked.agg(*(F.min(F.when(F.col("share") > s, F.col("n"))).alias(f"th{i + 1}") for i, s in enumerate(shares)))


def collate(df: DataFrame, *keys: str) -> DataFrame:
    """Sums, counts, maxima, distinct states and geometric means of a metric table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.sum("bits").alias("bits"), F.sum("points").alias("points"), F.max("peak").alias("peak"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("status"), F.exp(F.avg(F.log("seconds"))).alias("geo_seconds"), F.avg("psnr").alias("psnr"))


def component_weights(residuals: DataFrame, key: str, first: str, other: str) -> DataFrame:
    """For each key the weight 1..8 that predicts ``other`` best from ``first`` (the least wins a tie), 0 where none helps. All eight sums are one pass."""
    errors = [F.sum(F.abs(F.col(other) - F.shiftright(F.col(first) * w + 2, 2))).alias(f"e{w}") for w in range(1, 9)]
    sums = residuals.groupBy(key).agg(F.sum(F.abs(other)).alias("base"), *errors)
    best = F.array_min(F.array(*(F.struct(F.col(f"e{w}").alias("e"), F.lit(w).alias("w")) for w in range(1, 9))))
    return sums.select(key, F.when(best["e"] < F.col("base"), best["w"]).otherwise(0).alias("w"))


def last_component_weights(residuals: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """For each key the least-squares weight of ``b`` on ``a`` in quarters, rounded and kept within -8..8."""
    sums = residuals.groupBy(key).agg(F.sum(F.col(a) * F.col(b)).alias("xy"), F.sum(F.col(a) * F.col(a)).alias("xx"))
    half = E.idiv(F.col("xx"), 2)
    top = F.col("xy") * 4 + F.when(F.col("xy") < 0, -half).otherwise(half)
    return sums.select(key, F.when(F.col("xx") == 0, F.lit(0).cast("bigint")).otherwise(E.clip(E.idiv(top, F.col("xx")), -8, 8)).alias("w"))
