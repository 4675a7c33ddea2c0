"""Motion between frames: costs of blocks, the choice of a reference, and where a motion comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators import project, reduce
from cloudloom.operators.kernels import estimate_motion

AXES = E.AXES
#: A block gives about this many samples at most.
SAMPLES_BITS = 6


def log_cost(distance: Column) -> Column:
    """16 times the binary logarithm of one more than a distance, rounded below 64 and by halving beyond."""
    x = distance + 1
    drop = F.greatest(F.lit(0), E.ilog2(x) - 5)
    return 16 * drop + F.round(16 * F.log2(F.call_function("shiftright", x.cast("bigint"), drop).cast("double"))).cast("int")


def block_costs(df: DataFrame, reference: DataFrame, size: int, window: int, frame: str = "frame") -> DataFrame:
    """(frame, cx, cy, cz, samples, cost): what it costs to say each block of ``df`` by the reference points within ``window`` of it.

    A block of n points gives every (1 + n / 64)-th one in order of idx; a sample costs the logarithm of its L1 distance to the nearest point of the window, at
    most twice the window; the sum is scaled up by the period. Blocks without a window cost nothing and are left out. Samples meet their window in an
    equi-join on the block, so a reference point makes at most about 64 rows a block.
    """
    block = [F.floor(F.col(a) / size).cast("long").alias(f"c{a}") for a in AXES]
    keys = [frame, *(f"c{a}" for a in AXES)]
    own = df.select(frame, "idx", *AXES, *block)
    sizes = own.groupBy(*keys).agg((F.lit(1) + F.shiftright(F.count(F.lit(1)), SAMPLES_BITS)).alias("period"))
    placed = own.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("idx")) - 1).join(sizes, keys)
    samples = placed.filter(F.col("r") % F.col("period") == 0).select(*keys, "idx", "period", *AXES)
    near = reference.select(frame, *(F.col(a).alias(f"w{a}") for a in AXES))
    for a in AXES:
        near = near.withColumn(f"c{a}", F.explode(F.array_distinct(F.array(*(F.floor((F.col(f"w{a}") + o) / size).cast("long") for o in (-window, 0, window))))))
    l1 = sum((F.abs(F.col(a) - F.col(f"w{a}")) for a in AXES[1:]), F.abs(F.col("x") - F.col("wx")))
    least = samples.join(near, keys).groupBy(*keys, "idx", "period").agg(F.least(F.min(l1), F.lit(2 * window)).alias("d"))
    costs = least.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("samples"), F.sum(log_cost(F.col("d"))).alias("sum"))
    return costs.select(frame, "cx", "cy", "cz", "samples", (F.col("period") * F.col("sum")).alias("cost"))


def reference_choice(df: DataFrame, level: int, frame: str = "frame") -> DataFrame:
    """(frame, nx, ny, nz, missed_before, missed_behind, behind): for each node of a frame that the frame before or behind has too, which of them predicts its children better.

    The only one that has the node is taken; of both, the one with fewer children wrong, the one behind where they are equally wrong.
    """
    own = reduce.occupancy(df, [level], (frame,)).drop("level")
    keys = [frame, "nx", "ny", "nz"]
    side = lambda step, name: own.withColumn(frame, F.col(frame) + step).withColumnRenamed("occupancy", name)
    both = own.join(side(1, "before"), keys, "left").join(side(-1, "behind"), keys, "left").filter("before is not null or behind is not null")
    wrong = lambda n: F.bit_count(F.col("occupancy").bitwiseXOR(F.col(n)))
    missed = both.select(*keys, wrong("before").alias("missed_before"), wrong("behind").alias("missed_behind"))
    return missed.withColumn("behind", F.coalesce(F.col("missed_before") >= F.col("missed_behind"), F.col("missed_before").isNull()))


def moved_reference(reference: DataFrame, current: DataFrame, source: str, motion: DataFrame | None = None, by: str = "frame", near: DataFrame | None = None) -> DataFrame:
    """The reference's points where a motion takes them. ``source``: ``none``, ``external`` (rows of ``motion``, applied outside its heights), or ``estimated`` from the points themselves and their pairs ``near`` (t, s), which are searched where they are not given."""
    if source == "none":
        return reference
    if source == "external":
        if motion is None:
            raise ValueError("an external motion needs its rows")
        return project.apply_motion(reference, motion)
    if source != "estimated":
        raise ValueError(f"no motion source {source}")
    m = estimate_motion(reference, current, by, near)
    one = m.groupBy(by).agg(*(F.max(F.when(F.col("axis") == a, F.struct("m0", "m1", "m2", "t"))).alias(f"m_{a}") for a in AXES))  # a row a frame
    rows = reference.join(one, by)
    at = lambda a: F.round(F.col(f"m_{a}.m0") * F.col("x") + F.col(f"m_{a}.m1") * F.col("y") + F.col(f"m_{a}.m2") * F.col("z") + F.col(f"m_{a}.t")).cast("int")
    return rows.select(*(c for c in reference.columns if c not in AXES), *(at(a).alias(a) for a in AXES)).select(*reference.columns)
