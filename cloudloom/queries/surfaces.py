"""Queries of surface geometry, over the static cloud at a thirty-second of its scale, in nodes of eight voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import surface
from cloudloom.queries.registry import query
from cloudloom.sources.clouds import SQL_INDEXED, SQL_POINTS, indexed_points, points
from cloudloom.sources.shared import staged

BITS, REACH = 3, 2
AXES = "xyz"
C = f"WITH {SQL_POINTS}, v AS (SELECT DISTINCT x >> 5 AS x, y >> 5 AS y, z >> 5 AS z FROM pts)"
SQL_EDGES = "e AS (SELECT * FROM (VALUES " + ", ".join(map(str, surface.EDGES)) + ") AS t(axis, hx, hy, hz))"


def voxels(s, d):
    return points(s, d, *AXES).select(*(F.shiftright(a, 5).alias(a) for a in AXES)).distinct()


def _near(r: int) -> str:
    return " AND ".join(f"(axis = {i} OR CASE WHEN h{a} = 0 THEN ({a} & 7) < {r} ELSE ({a} & 7) > {7 - r} END)" for i, a in enumerate(AXES))


SQL_VERTICES = f"""{SQL_EDGES}, w AS (SELECT axis, (x >> 3) + hx AS sx, (y >> 3) + hy AS sy, (z >> 3) + hz AS sz, CASE WHEN {_near(1)} THEN 1 ELSE 0 END AS one, CASE WHEN {_near(REACH)} THEN 1 ELSE 0 END AS two,
  (CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END) & 7 AS at_ FROM v, e),
g AS (SELECT axis, sx, sy, sz, CAST(sum(one) AS BIGINT) AS n1, CAST(sum(two) AS BIGINT) AS n2, CAST(sum(one * at_) AS BIGINT) AS s1, CAST(sum(two * at_) AS BIGINT) AS s2 FROM w GROUP BY 1, 2, 3, 4)"""


@query(f"{C}, {SQL_VERTICES} SELECT axis, sx, sy, sz, n1, n2, (((2*s1 + s2) << 10) // (2*n1 + n2) + 512) >> 10 AS vertex FROM g WHERE n1 > 0 OR n2 > 1")
def tri02_edge_vertices(s, d):
    return surface.edge_vertices(voxels(s, d), BITS, REACH)


@query(f"{C}, {SQL_EDGES}, n AS (SELECT DISTINCT x >> 3 AS nx, y >> 3 AS ny, z >> 3 AS nz FROM v), st AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, -1)) AS t(grp, step)), "
  "m AS (SELECT axis, nx + hx + CASE WHEN axis = 0 THEN step ELSE 0 END AS sx, ny + hy + CASE WHEN axis = 1 THEN step ELSE 0 END AS sy, nz + hz + CASE WHEN axis = 2 THEN step ELSE 0 END AS sz, "
  "1 << (4*grp + CASE axis WHEN 0 THEN 2*hy + hz WHEN 1 THEN 2*hx + hz ELSE 2*hx + hy END) AS bit FROM n, e, st) SELECT axis, sx, sy, sz, bit_or(bit) AS mask FROM m GROUP BY 1, 2, 3, 4 HAVING bit_or(bit) & 15 > 0")
def jn20_edge_neighbours(s, d):
    return surface.edge_neighbours(voxels(s, d), BITS)


SQL_PAIRS = "p AS (SELECT nx, ny, nz, i, sqrt(CAST(d AS DOUBLE)) AS dist, row_number() OVER (PARTITION BY nx, ny, nz, i ORDER BY d) AS r FROM (SELECT a.x >> 3 AS nx, a.y >> 3 AS ny, a.z >> 3 AS nz, CAST(a.x AS BIGINT)*67108864 + a.y*8192 + a.z AS i, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d FROM v a JOIN v b ON a.x >> 3 = b.x >> 3 AND a.y >> 3 = b.y >> 3 AND a.z >> 3 = b.z >> 3 AND (a.x, a.y, a.z) <> (b.x, b.y, b.z)))"


@query(f"{C}, {SQL_PAIRS}, e AS (SELECT nx, ny, nz, avg(m) AS spacing FROM (SELECT nx, ny, nz, i, avg(dist) AS m FROM p WHERE r <= 4 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), "
  "b AS (SELECT x >> 3 AS nx, y >> 3 AS ny, z >> 3 AS nz, count(*) AS n, list_sort([max(x) - min(x), max(y) - min(y), max(z) - min(z)]) AS l FROM v GROUP BY 1, 2, 3) "
  "SELECT nx, ny, nz, n, round(8.0::DOUBLE / sqrt(CAST(n AS DOUBLE)), 6) AS area, round(sqrt(CAST(l[3] * l[2] AS DOUBLE) / n), 6) AS tight, round(spacing, 6) AS spacing FROM b LEFT JOIN e USING (nx, ny, nz)")
def tri03_sampling_estimates(s, d):
    e = surface.sampling_estimates(staged(voxels(s, d), "voxels"), BITS)
    return e.select("nx", "ny", "nz", "n", *(F.round(c, 6).alias(c) for c in ("area", "tight", "spacing")))


@query()
def tri04_agg24_drifted_centroids(s, d):
    """Polygons of the nodes with weighted centroid, normal and drift."""
    v = voxels(s, d)
    nodes = v.select(*(F.shiftright(a, BITS).alias(f"n{a}") for a in AXES)).distinct()
    each = surface.node_vertices(surface.edge_vertices(v, BITS, REACH), nodes, BITS)
    return surface.drifted(surface.polygons(each, BITS), v, BITS)


@query()
def tri05_face_vertices(s, d):
    shapes = tri04_agg24_drifted_centroids(s, d)
    return surface.face_vertices(surface.face_candidates(shapes, BITS), voxels(s, d), BITS, REACH)


@query()
def tri01_tri06_surface_voxels(s, d):
    """The voxels of the whole chain, at the ray distance that keeps them within the number of points."""
    v = voxels(s, d)
    return surface.surface_within(v, BITS, v.count())[0]


#: Triangles with corners of three columns each, and a ray along x for each row.
_CORNERS = {"v0": ("x % 2048", "y % 2048", "z % 2048"), "v1": ("(x * 7 + 300) % 2048", "(y * 3) % 2048", "(z * 5 + 900) % 2048"), "v2": ("(x * 3 + 1000) % 2048", "(y * 5 + 700) % 2048", "(z * 11) % 2048")}
_RAY = ("0", "(c0 * 8) % 2048", "(c1 * 24) % 2048")
SQL_TRIANGLES = "t AS (SELECT idx, " + ", ".join(f"CAST({e} AS BIGINT) AS {v}{a}" for v, es in _CORNERS.items() for a, e in zip(AXES, es, strict=True)) + ", " + ", ".join(f"CAST({e} AS BIGINT) AS r{a}" for a, e in zip(AXES, _RAY, strict=True)) + " FROM pts)"


def _tdiv(a: str, b: str) -> str:
    return f"(sign({a}) * sign({b}) * (abs({a}) // nullif(abs({b}), 0)))"


@query(f"WITH {SQL_INDEXED}, {SQL_TRIANGLES}, g AS (SELECT idx, " + ", ".join(f"v1{a} - v0{a} AS e{a}, v2{a} - v0{a} AS f{a}, r{a} - v0{a} AS s{a}" for a in AXES) + " FROM t), "
  "h AS (SELECT *, (-256 * fz) >> 8 AS hy, (256 * fy) >> 8 AS hz, sy*ez - sz*ey AS qx, sz*ex - sx*ez AS qy, sx*ey - sy*ex AS qz FROM g), k AS (SELECT *, (ey*hy + ez*hz) >> 8 AS a FROM h), "
  f"u AS (SELECT idx, {_tdiv('(sy*hy + sz*hz)', 'a')} AS u, {_tdiv('qx', 'a')} AS v, {_tdiv('(fx*(qx >> 8) + fy*(qy >> 8) + fz*(qz >> 8))', 'a')} AS t FROM k WHERE abs(a) > 256) SELECT idx, CAST(t AS BIGINT) AS t FROM u WHERE u >= 0 AND v >= 0 AND 256 - u - v >= 0")
def flt12_ray_triangle_hits(s, d):
    """The rays along x that meet their triangle, and how far along; 8 fractional bits."""
    p = indexed_points(s, d, "x", "y", "z", "c0", "c1")
    corner = {f"{v}{a}": F.expr(e).cast("long") for v, es in _CORNERS.items() for a, e in zip(AXES, es, strict=True)} | {f"r{a}": F.expr(e).cast("long") for a, e in zip(AXES, _RAY, strict=True)}
    t = p.select("idx", *(c.alias(n) for n, c in corner.items()))
    e, f, o = ([F.col(f"{v}{a}") - F.col(f"v0{a}") for a in AXES] for v in ("v1", "v2", "r"))
    return surface.hits_along_x(t, e, f, o).select("idx", "t")
