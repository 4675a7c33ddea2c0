"""Column builders for integer point arithmetic. All stay in generated code; none is a Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")

#: Attribute step sizes of a sixth of a doubling, with their reciprocals at 2^26 / step.
ATTRIBUTE_STEPS = (161, 181, 203, 228, 256, 287)
#: Axis orders by code.
AXIS_ORDERS = ("zyx", "xyz", "xzy", "yzx", "zyx", "zxy", "yxz", "xyz")


def c(x: Column | str | int | float) -> Column:
    """A column of a name, or a literal of a number."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clip(x: Column, low: Column | int | float, high: Column | int | float) -> Column:
    return F.least(F.greatest(x, c(low)), c(high))


def idiv(a: Column, b: Column | int) -> Column:
    """Integer quotient toward zero, exact over 64 bits."""
    return F.call_function("div", a.cast("bigint"), c(b).cast("bigint"))


def shift_toward_zero(x: Column, k: int) -> Column:
    return F.when(x >= 0, F.shiftright(x, k)).otherwise(-F.shiftright(-x, k))


def shift_half_up(x: Column, k: int) -> Column:
    return F.shiftright(x + F.lit((1 << k) >> 1), k) if k else x


def shift_half_away(x: Column, k: int) -> Column:
    if not k:
        return x
    half = F.lit((1 << k) >> 1)
    return F.when(x >= 0, F.shiftright(x + half, k)).otherwise(-F.shiftright(half - x, k))


def quantise(x: Column | str, scale: float, offset: int = 0) -> Column:
    return (F.round(c(x) * F.lit(float(scale))) - offset).cast("int")


def morton(x: Column | str, y: Column | str, z: Column | str) -> Column:
    """Interleaved address, x in the highest bit of each triple; 21 bits an axis."""

    def spread(v: Column) -> Column:
        v = v.cast("bigint").bitwiseAND(F.lit((1 << 21) - 1))
        for k, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, k)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(c(x)), 2).bitwiseOR(F.shiftleft(spread(c(y)), 1)).bitwiseOR(spread(c(z)))


MORTON_X, MORTON_Y, MORTON_Z = (0x1249249249249249 << k & (1 << 63) - 1 for k in (2, 1, 0))


def morton_add(a: Column, b: Column) -> Column:
    """Sum of two addresses axis by axis, carries kept inside each axis."""
    parts = []
    for own in (MORTON_X, MORTON_Y, MORTON_Z):
        other = (1 << 63) - 1 & ~own
        parts.append((a.bitwiseOR(F.lit(other)) + b.bitwiseAND(F.lit(own))).bitwiseAND(F.lit(own)))
    return reduce(lambda p, q: p.bitwiseOR(q), parts)


def morton_subtract(a: Column, b: Column) -> Column:
    """Difference of two addresses axis by axis; an axis below 0 wraps to an address that no cloud has."""
    parts = [(a.bitwiseAND(F.lit(own)) - b.bitwiseAND(F.lit(own))).bitwiseAND(F.lit(own)) for own in (MORTON_X, MORTON_Y, MORTON_Z)]
    return reduce(lambda p, q: p.bitwiseOR(q), parts)


def ilog2(x: Column) -> Column:
    """Place of the highest set bit of a positive number, without floating point."""
    return F.length(F.bin(x.cast("bigint"))) - 1


def ceil_log2(x: Column) -> Column:
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin((x - 1).cast("bigint"))))


def ceil_pow2(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), ceil_log2(x))


def ycbcr(g: Column, b: Column, r: Column) -> list[Column]:
    """BT.709, 8 bits, rounded half away from zero and clipped."""
    y = F.round(F.lit(0.212600) * r + F.lit(0.715200) * g + F.lit(0.072200) * b)
    u = F.round(F.lit(-0.114572) * r - F.lit(0.385428) * g + F.lit(0.5) * b + F.lit(128.0))
    v = F.round(F.lit(0.5) * r - F.lit(0.454153) * g - F.lit(0.045847) * b + F.lit(128.0))
    return [clip(t, 0.0, 255.0).cast("int") for t in (y, u, v)]


def gbr_of_ycbcr(y: Column, u: Column, v: Column) -> list[Column]:
    u, v = u - F.lit(128.0), v - F.lit(128.0)
    r = F.round(y + F.lit(1.57480) * v)
    g = F.round(y - F.lit(0.18733) * u - F.lit(0.46813) * v)
    b = F.round(y + F.lit(1.85563) * u)
    return [clip(t, 0.0, 255.0).cast("int") for t in (g, b, r)]


def ycgco(g: Column, b: Column, r: Column, bits: int = 8) -> list[Column]:
    """The reversible lifting: luma, and two chroma values lifted to be positive."""
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return [t + F.shiftright(cg, 1), cg + (1 << bits), co + (1 << bits)]


def gbr_of_ycgco(y: Column, cg: Column, co: Column, bits: int = 8) -> list[Column]:
    cg, co = cg - (1 << bits), co - (1 << bits)
    t = y - F.shiftright(cg, 1)
    b = t - F.shiftright(co, 1)
    return [clip(v, 0, (1 << bits) - 1) for v in (cg + t, b, co + b)]


def reciprocal(b: Column) -> tuple[Column, Column]:
    """(about 2^16 / the divisor's top 8 bits, bits dropped): what the 256-entry division table holds, by its rule."""
    n = F.greatest(F.lit(0), ilog2(b) - 7)
    top = F.call_function("shiftright", b.cast("bigint") + F.call_function("shiftright", F.call_function("shiftleft", F.lit(1).cast("bigint"), n), F.lit(1)), n)
    return idiv(top + 131072, top * 2), n


def div_approx(a: Column, b: Column, scale_bits: int = 0) -> Column:
    """a * 2^scale_bits / b by the reciprocal of the divisor's top 8 bits."""
    inverse, n = reciprocal(b)
    return F.call_function("shiftright", inverse * a, n + 16 - scale_bits)


def attribute_step(qp: Column) -> Column:
    q = F.greatest(qp, F.lit(4))
    base = F.element_at(F.array(*map(F.lit, ATTRIBUTE_STEPS)), (q % 6 + 1).cast("int"))
    return F.call_function("shiftleft", base.cast("bigint"), F.floor(q / 6).cast("int"))


def attribute_quantised(x: Column, qp: int) -> Column:
    """The level of a value with 8 fractional bits, by the step's reciprocal, with a dead zone of two thirds of a step on both sides of 0."""
    q = max(qp, 4)
    inverse, third = (1 << 26) // ATTRIBUTE_STEPS[q % 6] >> q // 6, (1 << 26) // 3
    x = x.cast("bigint")
    return F.when(x >= 0, F.shiftright(x * inverse + third, 26)).otherwise(-F.shiftright(third - x * inverse, 26))


def attribute_scaled(level: Column, qp: int) -> Column:
    """The whole value that a level stands for."""
    q = max(qp, 4)
    return shift_half_up(level * (ATTRIBUTE_STEPS[q % 6] << q // 6), 8)


def code_bits(level: Column) -> Column:
    """Length of a level in a code of growing groups: 1 for 0, two more for each doubling."""
    return 2 * F.length(F.bin(F.abs(level.cast("bigint")) + 1)) - 1


def geometry_scaled(x: Column, qp: Column) -> Column:
    """Inverse geometry quantiser: eight steps a doubling."""
    step = F.call_function("shiftleft", (qp % 8 + 8).cast("bigint"), F.shiftright(qp, 3))
    return F.shiftright(x * step + 4, 3)


def distance2(*pairs: tuple[Column, Column]) -> Column:
    return reduce(lambda a, b: a + b, ((p - q).cast("bigint") * (p - q).cast("bigint") for p, q in pairs))
