"""Fixed-point roots and trigonometry in columns. Table values come from the functions they sample, so no table is listed.

Square roots and reciprocal roots are exact, where a codec would take a few Newton steps; angles interpolate the same samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E

#: Bits of a sine, of the angle steps it is sampled at, and of an arc tangent; a half and a quarter turn in its units.
SINE_BITS, SINE_STEPS, ANGLE_BITS = 24, 12, 20
HALF_TURN, QUARTER_TURN = 3294199, 1647099
#: Bits of heights and of laser tangents.
HEIGHT_BITS, TANGENT_BITS = 3, 20


def root(x: Column) -> Column:
    """Integer square root, rounded down."""
    r = F.floor(F.sqrt(x.cast("double")))
    return F.when(r * r > x, r - 1).when((r + 1) * (r + 1) <= x, r + 1).otherwise(r)


def reciprocal_root(x: Column) -> Column:
    """2^40 over the square root, rounded down; 0 for 0."""
    return F.when(x == 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.lit(float(1 << 40)) / F.sqrt(x.cast("double"))))


def _arc_sample(i: Column) -> Column:
    return F.round(F.asin(F.least(i, F.lit(362)) / 512.0) * (1 << ANGLE_BITS)).cast("bigint")


def _arc(y: Column, x: Column) -> Column:
    """Arc tangent of y / x for 0 <= y <= x: the arc sine of y over the length, in a straight line between samples."""
    r = F.shiftright(y * reciprocal_root(x * x + y * y), 20)
    i = F.shiftright(r, 11)
    rest = r - F.shiftleft(i, 11)
    return F.when(x == 0, F.lit(0).cast("bigint")).otherwise(_arc_sample(i) + F.shiftright(rest * (_arc_sample(i + 1) - _arc_sample(i)), 11))


def arc_tangent(y: Column, x: Column) -> Column:
    """Angle of (x, y) with 20 fractional bits."""
    xa, ya = F.abs(x), F.abs(y)
    t = F.when(ya <= xa, _arc(ya, xa)).otherwise(QUARTER_TURN - _arc(xa, ya))
    t = F.when(x < 0, HALF_TURN - t).otherwise(t)
    return F.when(y < 0, -t).otherwise(t)


def _sine_sample(i: Column) -> Column:
    return F.round(F.sin(i * (2 * math.pi / (1 << SINE_STEPS))) * (1 << SINE_BITS)).cast("bigint")


def _sine0(x: Column, bits: int) -> Column:
    """Sine of 0 to a quarter turn."""
    drop = bits - SINE_STEPS
    i = F.shiftright(x, drop)
    rest = x - F.shiftleft(i, drop)
    return _sine_sample(i) + F.shiftright(rest * (_sine_sample(i + 1) - _sine_sample(i)) + ((1 << drop) >> 1), drop)


def sine(x: Column, bits: int) -> Column:
    """Sine with 24 fractional bits of an angle of 2^bits a turn, kept within half a turn."""
    half, quarter = 1 << bits - 1, 1 << bits - 2
    x = E.clip(x.cast("bigint"), -half, half)
    a = F.abs(x)
    s = F.when(a >= quarter, _sine0(half - a, bits)).otherwise(_sine0(a, bits))
    return F.when(x < 0, -s).otherwise(s)


def cosine(x: Column, bits: int) -> Column:
    half, quarter = 1 << bits - 1, 1 << bits - 2
    a = F.least(F.abs(x.cast("bigint")), F.lit(half))
    return F.when(a <= quarter, _sine0(quarter - a, bits)).otherwise(-_sine0(a - quarter, bits))
