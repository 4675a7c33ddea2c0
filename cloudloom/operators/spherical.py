"""Conversion between places and (radius, azimuth, laser), in integers.

A laser has a tangent of its elevation (20 fractional bits) and a height (3 fractional bits). Laser tables are small and become literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.functions import fixed as X

#: Laser tables that become an expression.
MOST_LASERS = 256
AXES = E.AXES


class Lasers:
    """Tangents and heights of the lasers, and what follows from them."""

    def __init__(self, table: Sequence[tuple[int, int]]):
        if not 0 < len(table) <= MOST_LASERS:
            raise ValueError(f"1 to {MOST_LASERS} lasers can be used")
        self.table = list(table)
        self.tangents, self.heights = (F.array(*(F.lit(v).cast("bigint") for v in vs)) for vs in zip(*self.table, strict=True))

    def _z(self, r: Column, tangent: Column | int, height: Column | int) -> Column:
        z = E.shift_half_away(r * tangent * 4, X.TANGENT_BITS - X.HEIGHT_BITS)
        return E.shift_half_away(z - height, X.HEIGHT_BITS)

    def z(self, r: Column, laser: Column) -> Column:
        """Height of the point of ``laser`` at radius ``r``."""
        return self._z(r, F.get(self.tangents, laser), F.get(self.heights, laser))

    def nearest(self, r: Column, z: Column) -> Column:
        """The laser whose point at radius ``r`` is nearest to ``z``; the first of equal ones."""
        return F.array_min(F.array(*(F.struct(F.abs(self._z(r, t, h) - z).alias("d"), F.lit(i).alias("k")) for i, (t, h) in enumerate(self.table))))["k"]


def to_cartesian(r: Column, phi: Column, laser: Column, lasers: Lasers, phi_bits: int, radius_bits: int = 0) -> list[Column]:
    """Places of (radius, azimuth, laser): the radius in 2^radius_bits, the azimuth in 2^phi_bits a turn."""
    r = F.shiftleft(r.cast("bigint"), radius_bits)
    return [E.shift_half_away(r * X.cosine(phi, phi_bits), X.SINE_BITS), E.shift_half_away(r * X.sine(phi, phi_bits), X.SINE_BITS), lasers.z(r, laser)]


def to_spherical(df: DataFrame, lasers: Lasers, phi_bits: int, radius_bits: int = 0, search: int = 2) -> DataFrame:
    """``df`` with (radius, phi, laser): the nearest values to a place's, within ``search`` of its rounded ones, whose place lies nearest to it (L1); the first in order of azimuth, then radius, wins."""
    x, y, z = (F.col(a).cast("bigint") for a in AXES)
    r0 = F.round(F.sqrt((x * x + y * y).cast("double"))).cast("bigint")
    phi0 = F.round(F.atan2(y.cast("double"), x.cast("double")) / (2 * 3.141592653589793) * (1 << phi_bits)).cast("bigint")
    rows = df.withColumns({"__r0": r0, "__phi0": phi0}).withColumns({"laser": lasers.nearest(F.col("__r0"), z), "__r": E.shift_half_up(F.col("__r0"), radius_bits)})

    def at(dr: int, dt: int, order: int) -> Column:
        r, phi = F.col("__r") + dr, F.col("__phi0") + dt
        away = fold(lambda p, q: p + q, (F.abs(a - b) for a, b in zip(to_cartesian(r, phi, F.col("laser"), lasers, phi_bits, radius_bits), (x, y, z), strict=True)))
        return F.struct(away.alias("e"), F.lit(order).alias("o"), r.alias("radius"), phi.alias("phi"))

    steps = [(dr, dt) for dt in range(-search, search + 1) for dr in range(-search, search + 1)]
    best = F.array_min(F.array(at(0, 0, -1), *(at(dr, dt, i) for i, (dr, dt) in enumerate(steps))))
    return rows.withColumn("__b", best).select(*df.columns, F.col("__b.radius").alias("radius"), F.col("__b.phi").alias("phi"), "laser")


def to_spherical_simple(df: DataFrame, lasers: Lasers, phi_bits: int, radius_bits: int = 0) -> DataFrame:
    """``df`` with (radius, phi, laser) by integer root and arc tangent, without a search."""
    x, y = (F.shiftleft(F.col(a).cast("bigint"), 8) for a in AXES[:2])
    half, shift = phi_bits - 1, 44 - (phi_bits - 1)
    turned = F.shiftright((X.arc_tangent(y, x) + X.HALF_TURN) * 5340354 + (1 << shift - 1), shift) - (1 << half)
    rows = df.withColumn("__r0", F.shiftright(X.root(x * x + y * y), 8))
    return rows.select(*df.columns, E.shift_half_up(F.col("__r0"), radius_bits).alias("radius"), turned.alias("phi"), lasers.nearest(F.col("__r0"), F.col("z").cast("bigint")).alias("laser"))


def to_laser_angles(df: DataFrame, lasers: Lasers, origin: tuple[int, int, int]) -> DataFrame:
    """``df`` with (radius, azimuth, laser) seen from ``origin``; the azimuth is not negative and has 12 fractional bits."""
    x, y = (F.shiftleft(F.col(a).cast("bigint") - o, 8) for a, o in zip(AXES[:2], origin, strict=False))
    rows = df.withColumn("__r0", F.shiftright(X.root(x * x + y * y), 8))
    return rows.select(*df.columns, F.col("__r0").alias("radius"), F.shiftright(X.arc_tangent(y, x) + X.HALF_TURN, 8).alias("azimuth"), lasers.nearest(F.col("__r0"), F.col("z").cast("bigint") - origin[2]).alias("laser"))


def azimuth_steps(turns: DataFrame) -> DataFrame:
    """(laser, n_phi, delta, inverse): the step of each laser's azimuth, a full turn of 20 fractional bits over its number of points, and its inverse with 30 bits."""
    full = 6588397
    return turns.withColumns({"delta": E.idiv(F.lit(full), F.col("n_phi")), "inverse": E.idiv(F.shiftleft(F.col("n_phi").cast("bigint"), 30), full)})
