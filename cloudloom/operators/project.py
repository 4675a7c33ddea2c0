"""Row-wise operators on clouds: scaling, clamping, colour, axis order, motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E

AXES = E.AXES


def quantise_positions(df: DataFrame, scale: float, offset: tuple[int, int, int] = (0, 0, 0), box: tuple[int, int] | None = None, exact_f32: bool = False) -> DataFrame:
    """Scaled, rounded half away from zero, moved and clamped positions; duplicates stay. ``exact_f32`` multiplies in single precision."""
    for a, o in zip(AXES, offset, strict=True):
        v = E.quantise(a, scale, o) if not exact_f32 else (F.round((F.col(a).cast("float") * F.lit(scale).cast("float")).cast("double")) - o).cast("int")
        df = df.withColumn(a, v if box is None else E.clip(v, *box))
    return df


def clamp(df: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    return df.withColumns({a: E.clip(F.col(a), lo, hi) for a, lo, hi in zip(AXES, low, high, strict=True)})


def shift(df: DataFrame, by: tuple[int, int, int]) -> DataFrame:
    return df.withColumns({a: F.col(a) + d for a, d in zip(AXES, by, strict=True)})


def output_scale(df: DataFrame, numerator: int, denominator_log2: int) -> DataFrame:
    """Positions times a dyadic rational, half up."""
    half = (1 << denominator_log2) >> 1
    return df.withColumns({a: F.shiftright(F.col(a) * numerator + half, denominator_log2) for a in AXES})


def reorder_axes(df: DataFrame, code: int, inverse: bool = False) -> DataFrame:
    """Axes named by one of the eight order codes, or back."""
    order = E.AXIS_ORDERS[code]
    pairs = dict(zip(order, AXES, strict=True)) if inverse else dict(zip(AXES, order, strict=True))
    return df.withColumns({to: F.col(of) for to, of in pairs.items()})


def reflectance_forward(v: Column, offset: int, frac_bits: int, scale: int) -> Column:
    return E.idiv(F.shiftleft(v - offset, frac_bits), scale)


def reflectance_inverse(v: Column, offset: int, frac_bits: int, scale: int) -> Column:
    return F.shiftright(v * scale, frac_bits) + offset


def axis_weights(box: DataFrame, forced_log2: int = 0) -> DataFrame:
    """Weights, in 8 fractional bits, that make the box's axes equally wide."""
    width = {a: F.col(f"max_{a}") - F.col(f"min_{a}") + 1 for a in AXES}
    widest = F.greatest(*width.values()) if not forced_log2 else F.lit(1 << forced_log2)
    most = F.least(F.lit(1 << 21), widest).cast("bigint")
    return box.select(*(f"min_{a}" for a in AXES), *(E.idiv(F.shiftleft(most, 8), w).alias(f"w_{a}") for a, w in width.items()))


def scale_by_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Positions relative to the box's corner, scaled by the weights; ``weights`` is one row."""
    both = df.crossJoin(F.broadcast(weights))  # one row
    return both.select(*(F.shiftright((F.col(a) - F.col(f"min_{a}")) * F.col(f"w_{a}") + 128, 8).alias(a) for a in AXES))


def shift_scaled(df: DataFrame, corner: tuple[int, int, int], weights: tuple[int, int, int]) -> DataFrame:
    """Adds the scaled corner, its sign kept apart from the shift."""
    moved = {}
    for a, m, w in zip(AXES, corner, weights, strict=True):
        moved[a] = F.col(a) + (-((-m * w) >> 8) if m < 0 else (m * w) >> 8)
    return df.withColumns(moved)


def apply_motion(df: DataFrame, motion: DataFrame, only_outside: bool = True) -> DataFrame:
    """Rigid motion of each frame: matrix in 16 fractional bits plus translation, on rows outside (z_bottom, z_top) or on all.

    ``motion`` has a row a frame. Rows of frames without motion stay.
    """
    joined = df.join(motion, "frame", "left")
    pos = [F.col(a).cast("bigint") for a in AXES]
    out = {}
    for r, a in enumerate(AXES):
        total = sum((F.col(f"m{r}{k}") * pos[k] for k in range(1, 3)), F.col(f"m{r}0") * pos[0])
        moved = E.shift_half_away(total, 16) + F.col(f"t{r}")
        when = F.col("m00").isNotNull()
        if only_outside:
            when = when & ((F.col("z") < F.col("z_bottom")) | (F.col("z") > F.col("z_top")))
        out[a] = F.when(when, moved).otherwise(F.col(a)).cast("int")
    return joined.withColumns(out).select(*df.columns)


def spherical(df: DataFrame, origin: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Radius and azimuth of each point around ``origin``, analytic."""
    x, y = F.col("x") - origin[0], F.col("y") - origin[1]
    return df.withColumns({"radius": F.hypot(x, y), "azimuth": F.atan2(y.cast("double"), x.cast("double"))})
