"""Attribute transfer from a source cloud to a target cloud, and the point-to-point distortion of two clouds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators.joins import apart, knn_join
from cloudloom.sources.shared import staged

AXES = E.AXES
#: Fixed value: limits from here on mean no limit.
UNLIMITED = 512


@dataclass(frozen=True)
class Direction:
    """How one direction of a transfer takes its neighbours: how many, up to which squared distances of place and of attribute, and their weights."""

    neighbours: int
    offset: float = 4.0
    weighted: bool = True
    same_place_only: bool = True
    most_distance2: float = 1000.0
    most_attribute2: float = 1000.0


FORWARD, BACKWARD = Direction(8), Direction(1, same_place_only=False)


def trimmed(edges: DataFrame, attributes: list[str], how: Direction) -> DataFrame:
    """``edges`` (t, s, d2, rank and attributes) without those that the limits of ``how`` rule out; the nearest of a target always stays.

    A target keeps the longest run of its nearest neighbours whose attributes are pairwise within the limit. The spread of a run only grows with
    its length, so it is a running maximum: of the component itself, or of distances to the neighbours before.
    """
    if how.most_distance2 < UNLIMITED:
        edges = edges.filter((F.col("d2") <= how.most_distance2) | (F.col("rank") == 1))
    w = Window.partitionBy("t").orderBy("rank")
    if how.same_place_only:
        edges = edges.withColumn("__least", F.first("d2").over(w)).filter((F.col("__least") >= 0.0001) | (F.col("rank") == 1)).drop("__least")
    if how.most_attribute2 < UNLIMITED:
        if len(attributes) == 1:
            gap = F.max(attributes[0]).over(w) - F.min(attributes[0]).over(w)
            spread: Column = gap.cast("double") * gap
        else:
            before = F.collect_list(F.struct(*attributes)).over(w)
            away = F.array_max(F.transform(before, lambda b: sum(((F.col(a) - b[a]) * (F.col(a) - b[a]) for a in attributes[1:]), (F.col(attributes[0]) - b[attributes[0]]) * (F.col(attributes[0]) - b[attributes[0]]))))
            edges = edges.withColumn("__away", away)
            spread = F.max("__away").over(w)
        edges = edges.withColumn("__spread", spread).filter(F.col("__spread") <= how.most_attribute2).drop("__spread", "__away")
    return edges


def _mean(attribute: str, weight: Column, how: Direction) -> Column:
    return F.sum(weight * F.col(attribute)) / F.sum(weight) if how.weighted else F.avg(attribute)


def recolour(targets: DataFrame, sources: DataFrame, attributes: list[str], forward: Direction = FORWARD, backward: Direction = BACKWARD, search: int = 1, high: int = 255, scale: tuple[int, int] = (1, 1), offset: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """``targets`` (idx, x, y, z) with ``attributes`` (three of a colour, or one) carried over from ``sources``.

    A source at p lies at p * scale - offset among the targets; ``scale`` is a quotient, so places stay integers on a common lattice.
    Forward: the mean over the nearest sources, weighted by 1 / (d2 + offset), or the one at the same place.
    Backward: every source votes for its nearest targets, weighted by 1 / (sqrt(d2) + offset). Where there are votes, the
    result is the value around their mean, within ``search`` in each component, of least max(e1 / targets, e2 / sources), e1 the
    squared error to the forward value and e2 that to all votes; the first in order wins. The sizes are those of the two clouds.
    Votes are kept as sums (n, sum, sum of squares), so a target with many votes is one row.
    """
    if len(attributes) not in (1, 3):
        raise ValueError("one or three components can be carried")
    up, down = scale
    t = targets.select("idx", *(((F.col(a).cast("bigint") + o) * down).alias(a) for a, o in zip(AXES, offset, strict=True)))
    src = sources.select("idx", *((F.col(a).cast("bigint") * up).alias(a) for a in AXES))
    values = sources.select(F.col("idx").alias("s"), *(F.col(a).cast("bigint").alias(a) for a in attributes))
    own = lambda df, by: df.withColumn("d2", F.col("d2") / float(by * by))
    near = trimmed(own(knn_join(t, src, forward.neighbours), up).join(apart(values), "s"), attributes, forward)
    w = 1.0 / (F.col("d2") + F.lit(forward.offset))
    clipped = lambda c: F.least(F.greatest(F.round(F.round(c, 9)), F.lit(0.0)), F.lit(float(high)))
    # a single neighbour is taken as it is, not by its mean
    alone = F.count(F.lit(1)) == 1
    forward_values = near.groupBy("t").agg(*(F.when(alone, F.first(a).cast("double")).otherwise(clipped(_mean(a, w, forward))).alias(f"w_{a}") for a in attributes))

    back = own(knn_join(src, t, backward.neighbours), down).select(F.col("t").alias("s"), F.col("s").alias("t"), "d2").join(apart(values), "s")
    if backward.most_distance2 < UNLIMITED:
        back = back.filter(F.col("d2") <= backward.most_distance2)
    if backward.same_place_only or backward.most_attribute2 < UNLIMITED:
        ranked = back.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy("d2", "s")))
        back = trimmed(ranked, attributes, Direction(backward.neighbours, same_place_only=backward.same_place_only, most_attribute2=backward.most_attribute2))
    v = 1.0 / (F.sqrt("d2") + F.lit(backward.offset))
    votes = back.groupBy("t").agg(F.count(F.lit(1)).alias("n"), *(e for a in attributes for e in (F.sum(a).alias(f"s_{a}"), F.sum(F.col(a) * F.col(a)).alias(f"q_{a}"), _mean(a, v, backward).alias(f"c_{a}"))))
    sizes = targets.agg(F.count(F.lit(1)).cast("double").alias("__nt")).crossJoin(sources.agg(F.count(F.lit(1)).cast("double").alias("__ns")))
    both = forward_values.join(apart(votes), "t", "left").crossJoin(F.broadcast(sizes))  # one row
    steps = list(range(-search, search + 1))
    offsets = [[i] for i in steps] if len(attributes) == 1 else [[i, j, k] for i in steps for j in steps for k in steps]
    tries = F.array(*(F.array(*(F.lit(float(o)) for o in off)) for off in offsets))
    centre = [clipped(F.col(f"c_{a}")) for a in attributes]

    def candidate(off: Column, place: Column) -> Column:
        value = [F.least(F.greatest(c + off[i], F.lit(0.0)), F.lit(float(high))) for i, c in enumerate(centre)]
        e1, e2 = F.lit(0.0), F.lit(0.0)
        for x, a in zip(value, attributes, strict=True):
            e1 = e1 + (x - F.col(f"w_{a}")) * (x - F.col(f"w_{a}"))
            e2 = e2 + (F.col("n") * x * x - 2 * x * F.col(f"s_{a}") + F.col(f"q_{a}"))
        return F.struct(F.greatest(e1 / F.col("__nt"), e2 / F.col("__ns")).alias("e"), place.alias("o"), *(x.alias(f"v{i}") for i, x in enumerate(value)))

    best = F.array_min(F.transform(tries, candidate))
    return both.select("t", "n", *(f"w_{a}" for a in attributes), best.alias("b")).select(F.col("t").alias("idx"), *(F.when(F.col("n").isNull(), F.col(f"w_{a}")).otherwise(F.col(f"b.v{i}")).cast("int").alias(a) for i, a in enumerate(attributes)))


def distortion(a: DataFrame, b: DataFrame, peak: float) -> DataFrame:
    """Mean squared nearest distance both ways, the larger of them, and its PSNR; largest squared nearest distance too."""
    one = staged(knn_join(a, b, 1), "d1").agg(F.avg("d2").alias("mse_ab"), F.max("d2").alias("max_ab"))
    two = staged(knn_join(b, a, 1), "d1").agg(F.avg("d2").alias("mse_ba"), F.max("d2").alias("max_ba"))
    both = one.crossJoin(F.broadcast(two))  # one row each
    mse = F.greatest("mse_ab", "mse_ba")
    return both.select("mse_ab", "mse_ba", mse.alias("mse"), F.greatest("max_ab", "max_ba").alias("hausdorff"), F.when(mse > 0, 10.0 * F.log10(F.lit(3.0 * peak * peak) / mse)).alias("psnr"))
