"""Queries of fixed-point trigonometry and spherical places."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import fixed as X
from cloudloom.operators import spherical
from cloudloom.queries.registry import query
from cloudloom.sources.clouds import SQL_INDEXED, SQL_POINTS, indexed_points, points

P, I = f"WITH {SQL_POINTS} ", f"WITH {SQL_INDEXED} "
LASERS = [(-200_000, 40), (0, 0), (150_000, -16), (400_000, 8), (900_000, 24)]
PHI_BITS, ORIGIN = 16, (500, 900, 100)
TURNS = [(0, 800), (1, 1000), (2, 1024), (3, 2048), (4, 4500)]


def shift_away(x: str, k: int) -> str:
    return f"(CASE WHEN {x} >= 0 THEN ({x} + {1 << k - 1}) >> {k} ELSE -(({1 << k - 1} - ({x})) >> {k}) END)"


def sql_sample(i: str) -> str:
    return f"CAST(round(sin(({i}) * {2 * 3.141592653589793 / 4096}::DOUBLE) * 16777216) AS BIGINT)"


def sql_sine0(x: str, bits: int) -> str:
    k = bits - 12
    i, j = f"(({x}) >> {k})", f"((({x}) >> {k}) + 1)"
    return f"({sql_sample(i)} + (((({x}) - ({i} << {k})) * ({sql_sample(j)} - {sql_sample(i)}) + {1 << k - 1}) >> {k}))"


def sql_sine(x: str, bits: int) -> str:
    half, quarter = 1 << bits - 1, 1 << bits - 2
    a = f"least(abs({x}), {half})"
    return f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * CASE WHEN {a} >= {quarter} THEN {sql_sine0(f'{half} - {a}', bits)} ELSE {sql_sine0(a, bits)} END)"


def sql_cosine(x: str, bits: int) -> str:
    half, quarter = 1 << bits - 1, 1 << bits - 2
    a = f"least(abs({x}), {half})"
    return f"(CASE WHEN {a} <= {quarter} THEN {sql_sine0(f'{quarter} - {a}', bits)} ELSE -{sql_sine0(f'{a} - {quarter}', bits)} END)"


def sql_z(r: str, tangent: str, height: str) -> str:
    z = shift_away(f"({r}) * ({tangent}) * 4", 17)
    return shift_away(f"({z} - ({height}))", 3)


def sql_nearest(r: str, z: str) -> str:
    return "list_min([" + ", ".join(f"row(abs({sql_z(r, str(t), str(h))} - ({z})), {i})" for i, (t, h) in enumerate(LASERS)) + "])"


def sql_pick(values: list[int], i: str) -> str:
    return f"CAST([{', '.join(map(str, values))}][{i} + 1] AS BIGINT)"


def sql_root(x: str) -> str:
    r = f"CAST(floor(sqrt(CAST({x} AS DOUBLE))) AS BIGINT)"
    return f"(CASE WHEN {r} * {r} > {x} THEN {r} - 1 WHEN ({r} + 1) * ({r} + 1) <= {x} THEN {r} + 1 ELSE {r} END)"


def sql_arc(y: str, x: str) -> str:
    """From columns or brackets: the arc tangent for 0 <= y <= x."""
    r = f"((({y}) * CAST(floor(1099511627776.0::DOUBLE / sqrt(CAST(({x})*({x}) + ({y})*({y}) AS DOUBLE))) AS BIGINT)) >> 20)"
    s = lambda i: f"CAST(round(asin(least({i}, 362) / 512.0::DOUBLE) * 1048576) AS BIGINT)"
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE {s(f'({r} >> 11)')} + ((({r} & 2047) * ({s(f'(({r} >> 11) + 1)')} - {s(f'({r} >> 11)')})) >> 11) END)"


def sql_angle(y: str, x: str) -> str:
    t = f"(CASE WHEN abs({y}) <= abs({x}) THEN {sql_arc(f'abs({y})', f'abs({x})')} ELSE 1647099 - {sql_arc(f'abs({x})', f'abs({y})')} END)"
    return f"(CASE WHEN {y} < 0 THEN -1 ELSE 1 END * CASE WHEN {x} < 0 THEN 3294199 - {t} ELSE {t} END)"


@query(P + ", w AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST((z * 26) % 65536 - 32768 AS BIGINT) AS phi FROM pts)"
  f" SELECT x, y, phi, {sql_root('(x*x + y*y)')} AS root, CASE WHEN x*x + y*y = 0 THEN 0 ELSE CAST(floor(1099511627776.0::DOUBLE / sqrt(CAST(x*x + y*y AS DOUBLE))) AS BIGINT) END AS inverse, {sql_sine('phi', 16)} AS sine, {sql_cosine('phi', 16)} AS cosine, {sql_angle('(y - 900)', '(x - 500)')} AS angle FROM w")
def prj23_roots_and_trig(s, d):
    p = points(s, d, "x", "y", "z").select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), (F.col("z") * 26 % 65536 - 32768).cast("long").alias("phi"))
    x, y = F.col("x"), F.col("y")
    return p.select("x", "y", "phi", X.root(x * x + y * y).alias("root"), X.reciprocal_root(x * x + y * y).alias("inverse"), X.sine(F.col("phi"), 16).alias("sine"), X.cosine(F.col("phi"), 16).alias("cosine"), X.arc_tangent(y - 900, x - 500).alias("angle"))


@query(P + f", o AS (SELECT x, y, z, CAST(x - {ORIGIN[0]} AS BIGINT) * 256 AS px, CAST(y - {ORIGIN[1]} AS BIGINT) * 256 AS py FROM pts), r AS (SELECT *, {sql_root('(px*px + py*py)')} >> 8 AS radius FROM o) SELECT x, y, z, radius, ({sql_angle('py', 'px')} + 3294199) >> 8 AS azimuth, CAST({sql_nearest('radius', f'(z - {ORIGIN[2]})')}[2] AS INT) AS laser FROM r")
def prj12_spherical(s, d):
    return spherical.to_laser_angles(points(s, d, "x", "y", "z"), spherical.Lasers(LASERS), ORIGIN)


def sql_place(r: str, phi: str, laser: str) -> list[str]:
    tangent, height = (sql_pick([t[i] for t in LASERS], laser) for i in (0, 1))
    return [shift_away(f"({r}) * {sql_cosine(phi, PHI_BITS)}", 24), shift_away(f"({r}) * {sql_sine(phi, PHI_BITS)}", 24), sql_z(r, tangent, height)]


@query(I + "SELECT idx, " + ", ".join(f"{e} AS {a}" for a, e in zip("xyz", sql_place("r", "phi", "laser"), strict=True)) + " FROM (SELECT idx, CAST(x AS BIGINT) AS r, CAST((y * 37) % 65536 - 32768 AS BIGINT) AS phi, laser % 5 AS laser FROM pts)")
def prj13_to_cartesian(s, d):
    p = indexed_points(s, d, "x", "y", "laser").select("idx", F.col("x").cast("long").alias("r"), (F.col("y") * 37 % 65536 - 32768).cast("long").alias("phi"), (F.col("laser") % 5).alias("laser"))
    x, y, z = spherical.to_cartesian(F.col("r"), F.col("phi"), F.col("laser"), spherical.Lasers(LASERS), PHI_BITS)
    return p.select("idx", x.alias("x"), y.alias("y"), z.alias("z"))


_AT = sql_place("r + dr", "phi + dt", "laser")


@query(I + f", b AS (SELECT idx, CAST(x - 500 AS BIGINT) AS x, CAST(y - 900 AS BIGINT) AS y, CAST(z - 300 AS BIGINT) AS z FROM pts), c AS (SELECT *, CAST(round(sqrt(CAST(x*x + y*y AS DOUBLE))) AS BIGINT) AS r, CAST(round(atan2(CAST(y AS DOUBLE), CAST(x AS DOUBLE)) / {2 * 3.141592653589793}::DOUBLE * 65536) AS BIGINT) AS phi FROM b), "
  f"e AS (SELECT *, {sql_nearest('r', 'z')}[2] AS laser FROM c), s AS (SELECT e.*, dr, dt, CASE WHEN dr = 0 AND dt = 0 THEN -1 ELSE (dt + 2)*5 + dr + 2 END AS o FROM e, (SELECT unnest([-2, -1, 0, 1, 2]) AS dr), (SELECT unnest([-2, -1, 0, 1, 2]) AS dt)), "
  f"g AS (SELECT idx, r + dr AS radius, phi + dt AS phi, laser, row(" + " + ".join(f"abs({e} - {a})" for a, e in zip("xyz", _AT, strict=True)) + ", o) AS k FROM s) SELECT idx, arg_min(radius, k) AS radius, arg_min(phi, k) AS phi, CAST(any_value(laser) AS INT) AS laser FROM g GROUP BY 1")
def prj14_to_spherical(s, d):
    p = indexed_points(s, d, "x", "y", "z").select("idx", (F.col("x") - 500).alias("x"), (F.col("y") - 900).alias("y"), (F.col("z") - 300).alias("z"))
    return spherical.to_spherical(p, spherical.Lasers(LASERS), PHI_BITS).select("idx", "radius", "phi", "laser")


@query(I + f", b AS (SELECT idx, CAST(x - 500 AS BIGINT) * 256 AS px, CAST(y - 900 AS BIGINT) * 256 AS py, CAST(z - 300 AS BIGINT) AS z FROM pts), c AS (SELECT *, {sql_root('(px*px + py*py)')} >> 8 AS r FROM b) SELECT idx, r AS radius, ((({sql_angle('py', 'px')} + 3294199) * 5340354 + {1 << 28}) >> 29) - 32768 AS phi, CAST({sql_nearest('r', 'z')}[2] AS INT) AS laser FROM c")
def prj15_to_spherical_simple(s, d):
    p = indexed_points(s, d, "x", "y", "z").select("idx", (F.col("x") - 500).alias("x"), (F.col("y") - 900).alias("y"), (F.col("z") - 300).alias("z"))
    return spherical.to_spherical_simple(p, spherical.Lasers(LASERS), PHI_BITS).select("idx", "radius", "phi", "laser")


@query(f"SELECT laser, n_phi, 6588397 // n_phi AS delta, (CAST(n_phi AS BIGINT) << 30) // 6588397 AS inverse FROM (VALUES {', '.join(map(str, TURNS))}) AS t(laser, n_phi)")
def prd06_azimuth_steps(s, d):
    return spherical.azimuth_steps(s.createDataFrame(TURNS, "laser int, n_phi int"))
