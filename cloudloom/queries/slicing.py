"""Slice, halo, node and laser queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import partition, slices
from cloudloom.queries.registry import query
from cloudloom.sources.clouds import SQL_FRAMES, SQL_INDEXED, frames, indexed_points

I, FR = f"WITH {SQL_INDEXED} ", f"WITH {SQL_FRAMES} "


def _near(axis: str, size: int, halo: int) -> str:
    own = f"CAST(floor({axis} / {size}.0) AS BIGINT)"
    return f"list_filter([{own}, CASE WHEN {axis} % {size} < {halo} THEN {own} - 1 END, CASE WHEN {axis} % {size} >= {size - halo} THEN {own} + 1 END], lambda v: v IS NOT NULL)"


@query(I + f", a AS (SELECT idx, x, y, unnest({_near('x', 128, 8)}) AS a FROM pts), b AS (SELECT idx, x, y, a, unnest({_near('y', 256, 8)}) AS b FROM a) SELECT idx, a, b, CASE WHEN a = CAST(floor(x / 128.0) AS BIGINT) AND b = CAST(floor(y / 256.0) AS BIGINT) THEN 'core' ELSE 'pad' END AS role FROM b")
def prt04_square_slices_with_halo(s, d):
    return slices.square_slices(indexed_points(s, d, "x", "y"), {"x": (128, "a"), "y": (256, "b")}, 8)


@query(FR + ", n AS (SELECT slice, count(*) AS n FROM frames GROUP BY 1), r AS (SELECT idx, slice, row_number() OVER (PARTITION BY slice ORDER BY y, idx) - 1 AS r FROM frames) SELECT idx, slice, CAST(floor(r * ceil(n / 700.0) / n) AS INT) AS part FROM r JOIN n USING (slice)")
def prt07_split_large_slices(s, d):
    return partition.split_slices(frames(s, d), "slice", "y", 700).select("idx", "slice", "part")


@query()
def prt03_uniform_slices(s, d):
    return partition.uniform_slices(frames(s, d).select("idx", "x", "y", "z"), 2000)


@query(I + "SELECT idx, row_number() OVER (PARTITION BY x >> 3, y >> 3, z >> 3 ORDER BY idx) > 1 AS duplicate FROM pts")
def flt07_node_duplicates(s, d):
    p = indexed_points(s, d, "x", "y", "z").select("idx", *(F.shiftright(a, 3).alias(a) for a in "xyz"))
    return slices.node_duplicates(p, 2).select("idx", "duplicate")


@query(I + "SELECT x & ~63 AS x, y & ~63 AS y, z & ~63 AS z, least((x & ~63) + 63, 1000) AS hx, least((y & ~63) + 63, 1500) AS hy, least((z & ~63) + 63, 2000) AS hz FROM pts")
def tri07_clipped_nodes(s, d):
    p = indexed_points(s, d, "x", "y", "z")
    low = {a: F.col(a).bitwiseAND(~63) for a in "xyz"}
    return p.select(*(v.alias(a) for a, v in low.items()), *(F.least(v + 63, F.lit(m)).alias(f"h{a}") for (a, v), m in zip(low.items(), (1000, 1500, 2000), strict=True)))


LASERS = [(0, 0), (150, 10), (300, 10), (600, -5), (900, -20), (1400, 7)]
_R = "CAST(floor(sqrt(CAST(x AS DOUBLE)*x + CAST(y AS DOUBLE)*y)) AS BIGINT)"
_PLANES = ", ".join(f"row(abs(z - ((({_R} * {t} + 512) >> 10) + {h})), {i}, (({_R} * {t} + 512) >> 10) + {h})" for i, (t, h) in enumerate(LASERS))


@query(I + f", n AS (SELECT idx, z, list_min([{_PLANES}]) AS m FROM pts) SELECT idx, CAST(m[2] AS INT) AS laser, CAST(CASE WHEN m[1] <= 40 THEN m[3] ELSE z END AS INT) AS z FROM n")
def prj28_laser_compensation(s, d):
    return slices.compensate_z(indexed_points(s, d, "x", "y", "z"), LASERS, 40).select("idx", "laser", "z")
