"""Projection and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators import filters, project, reduce
from cloudloom.queries.registry import query
from cloudloom.sources.clouds import SQL_FRAMES, SQL_POINTS, SQL_SMALL, frames, points, small_points

P, FR, S3 = f"WITH {SQL_POINTS} ", f"WITH {SQL_FRAMES} ", f"WITH {SQL_SMALL} "
MOTION_ROWS = "(1, 65536, 0, 0, 0, 65536, 0, 0, 0, 65536, 5, -3, 2, 100, 20), (2, 65000, 1200, 0, -1200, 65000, 0, 0, 0, 65536, 0, 7, 0, 200, 10), (3, 64000, 0, 800, 0, 65536, 0, -800, 0, 64000, -9, 0, 1, 150, 50)"
MOTION_NAMES = "frame, m00, m01, m02, m10, m11, m12, m20, m21, m22, t0, t1, t2, z_top, z_bottom"
SQL_MOTION = f"motion AS (SELECT * FROM (VALUES {MOTION_ROWS}) AS t({MOTION_NAMES}))"


def motion(spark):
    return spark.sql(f"SELECT * FROM VALUES {MOTION_ROWS} AS t({MOTION_NAMES})")


def _spread(v: str) -> str:
    e = f"(CAST({v} AS BIGINT) & 2097151)"
    for k, m in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        e = f"(({e} | ({e} << {k})) & {m})" if k == 32 else f"list_transform([{e}], lambda s: (s | (s << {k})) & {m})[1]"
    return e


def sql_morton(x: str, y: str, z: str) -> str:
    return f"(({_spread(x)} << 2) | ({_spread(y)} << 1) | {_spread(z)})"


@query(P + "SELECT least(greatest(CAST(round(x*0.25) AS INT) - 3, 0), 400) AS x, least(greatest(CAST(round(y*0.25) AS INT) - 1, 0), 400) AS y, least(greatest(CAST(round(z*0.25) AS INT), 0), 400) AS z FROM pts")
def prj01_quantise_positions(s, d):
    return project.quantise_positions(points(s, d, "x", "y", "z"), 0.25, (3, 1, 0), (0, 400))


@query(P + "SELECT least(greatest(x, 100), 900) AS x, least(greatest(y, 50), 1500) AS y, least(greatest(z, 10), 2000) AS z, refl FROM pts")
def prj02_clamp_volume(s, d):
    return project.clamp(points(s, d, "x", "y", "z", "refl"), (100, 50, 10), (900, 1500, 2000))


@query(P + "SELECT x - 17 AS x, y + 5 AS y, z + 1000 AS z FROM pts")
def prj03_shift_positions(s, d):
    return project.shift(points(s, d, "x", "y", "z"), (-17, 5, 1000))


@query(P + "SELECT (x*3 + 2) >> 2 AS x, (y*3 + 2) >> 2 AS y, (z*3 + 2) >> 2 AS z FROM pts")
def prj04_output_scale(s, d):
    return project.output_scale(points(s, d, "x", "y", "z"), 3, 2)


@query(P + "SELECT y AS x, z AS y, x AS z FROM pts")
def prj05_axis_order(s, d):
    return project.reorder_axes(points(s, d, "x", "y", "z"), 3)


@query(P + "SELECT x, y, z FROM pts")
def prj05_axis_order_round_trip(s, d):
    return project.reorder_axes(project.reorder_axes(points(s, d, "x", "y", "z"), 3), 3, inverse=True)


YCBCR = """CAST(least(greatest(round(0.212600::DOUBLE*c2 + 0.715200::DOUBLE*c0 + 0.072200::DOUBLE*c1), 0), 255) AS INT) AS y,
 CAST(least(greatest(round(-0.114572::DOUBLE*c2 - 0.385428::DOUBLE*c0 + 0.5::DOUBLE*c1 + 128.0::DOUBLE), 0), 255) AS INT) AS u,
 CAST(least(greatest(round(0.5::DOUBLE*c2 - 0.454153::DOUBLE*c0 - 0.045847::DOUBLE*c1 + 128.0::DOUBLE), 0), 255) AS INT) AS v"""


@query(P + f"SELECT c0, c1, c2, {YCBCR} FROM pts")
def prj06_gbr_to_ycbcr(s, d):
    p = points(s, d, "c0", "c1", "c2")
    return p.select("c0", "c1", "c2", *(e.alias(n) for n, e in zip("yuv", E.ycbcr(F.col("c0"), F.col("c1"), F.col("c2")), strict=True)))


@query(P + f", t AS (SELECT {YCBCR} FROM pts) SELECT y, u, v, CAST(least(greatest(round(y - 0.18733::DOUBLE*(u-128) - 0.46813::DOUBLE*(v-128)), 0), 255) AS INT) AS g, CAST(least(greatest(round(y + 1.85563::DOUBLE*(u-128)), 0), 255) AS INT) AS b, CAST(least(greatest(round(y + 1.57480::DOUBLE*(v-128)), 0), 255) AS INT) AS r FROM t")
def prj07_ycbcr_to_gbr(s, d):
    p = points(s, d, "c0", "c1", "c2").select(*(e.alias(n) for n, e in zip("yuv", E.ycbcr(F.col("c0"), F.col("c1"), F.col("c2")), strict=True)))
    return p.select("y", "u", "v", *(e.alias(n) for n, e in zip("gbr", E.gbr_of_ycbcr(F.col("y"), F.col("u"), F.col("v")), strict=True)))


YCGCO = """(c1 + ((c2-c1) >> 1)) + ((c0 - (c1 + ((c2-c1) >> 1))) >> 1) AS yy, c0 - (c1 + ((c2-c1) >> 1)) + 256 AS cg, c2 - c1 + 256 AS co"""


@query(P + f"SELECT c0, c1, c2, {YCGCO} FROM pts")
def prj08_gbr_to_ycgco(s, d):
    p = points(s, d, "c0", "c1", "c2")
    return p.select("c0", "c1", "c2", *(e.alias(n) for n, e in zip(("yy", "cg", "co"), E.ycgco(F.col("c0"), F.col("c1"), F.col("c2")), strict=True)))


@query(P + "SELECT c0, c1, c2 FROM pts")
def prj09_ycgco_round_trip(s, d):
    p = points(s, d, "c0", "c1", "c2").select(*(e.alias(n) for n, e in zip(("a", "b", "e"), E.ycgco(F.col("c0"), F.col("c1"), F.col("c2")), strict=True)))
    return p.select(*(e.alias(n) for n, e in zip(("c0", "c1", "c2"), E.gbr_of_ycgco(F.col("a"), F.col("b"), F.col("e")), strict=True)))


@query(P + "SELECT x, z, (c1 + ((c2-c1) >> 1)) + ((c0 - (c1 + ((c2-c1) >> 1))) >> 1) AS c0, c0 - (c1 + ((c2-c1) >> 1)) + 256 AS c1, c2 - c1 + 256 AS c2 FROM pts")
def prj10_convert_cloud_colour(s, d):
    p = points(s, d, "x", "z", "c0", "c1", "c2")
    return p.select("x", "z", *(e.alias(n) for n, e in zip(("c0", "c1", "c2"), E.ycgco(F.col("c0"), F.col("c1"), F.col("c2")), strict=True)))


@query(P + "SELECT refl, CAST(((refl - 10) * 16) // 3 AS BIGINT) AS fwd, ((refl * 3) >> 4) + 10 AS inv FROM pts")
def prj11_reflectance_affine(s, d):
    r = F.col("refl")
    return points(s, d, "refl").select("refl", project.reflectance_forward(r, 10, 4, 3).alias("fwd"), project.reflectance_inverse(r, 10, 4, 3).alias("inv"))



SQL_WEIGHTS = """box AS (SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x)-min(x)+1 AS wx, max(y)-min(y)+1 AS wy, max(z)-min(z)+1 AS wz FROM pts),
w AS (SELECT min_x, min_y, min_z, (CAST(least(2097152, greatest(wx, wy, wz)) AS BIGINT) << 8) // wx AS w_x, (CAST(least(2097152, greatest(wx, wy, wz)) AS BIGINT) << 8) // wy AS w_y, (CAST(least(2097152, greatest(wx, wy, wz)) AS BIGINT) << 8) // wz AS w_z FROM box)"""


@query(P + f", {SQL_WEIGHTS} SELECT ((x-min_x)*w_x + 128) >> 8 AS x, ((y-min_y)*w_y + 128) >> 8 AS y, ((z-min_z)*w_z + 128) >> 8 AS z FROM pts, w")
def prj16_normalise_axes(s, d):
    p = points(s, d, "x", "y", "z")
    return project.scale_by_weights(p, project.axis_weights(reduce.bounding_box(p)))


@query(P + "SELECT x - ((37*300) >> 8) AS x, y + ((12*256) >> 8) AS y, z - ((5*77) >> 8) AS z FROM pts")
def prj17_shift_scaled(s, d):
    return project.shift_scaled(points(s, d, "x", "y", "z"), (-37, 12, -5), (300, 256, 77))


@query(P + f"SELECT x, y, z, {sql_morton('x', 'y', 'z')} AS morton FROM pts")
def prj18_morton(s, d):
    return points(s, d, "x", "y", "z").withColumn("morton", E.morton("x", "y", "z"))


@query(P + f"SELECT x, y, z, {sql_morton('x+3', 'y+1', 'z+6')} AS moved FROM pts")
def prj19_morton_add(s, d):
    by = E.morton(F.lit(3), F.lit(1), F.lit(6))
    return points(s, d, "x", "y", "z").withColumn("moved", E.morton_add(E.morton("x", "y", "z"), by))


@query(P + "SELECT y, CAST(bit_count(y) AS INT) AS ones, CAST(length(bin(y)) - 1 AS INT) AS log2, CAST(CASE WHEN y <= 1 THEN 0 ELSE length(bin(y-1)) END AS INT) AS ceil_log2, CAST(1::BIGINT << CAST(CASE WHEN y <= 1 THEN 0 ELSE length(bin(y-1)) END AS INT) AS BIGINT) AS pow2 FROM pts WHERE y > 0")
def prj20_bit_helpers(s, d):
    y = F.col("y")
    return points(s, d, "y").filter("y > 0").select("y", F.bit_count("y").alias("ones"), E.ilog2(y).alias("log2"), E.ceil_log2(y).alias("ceil_log2"), E.ceil_pow2(y).alias("pow2"))


@query(P + "SELECT v, CASE WHEN v >= 0 THEN v >> 3 ELSE -((-v) >> 3) END AS toward_zero, (v + 4) >> 3 AS half_up, CASE WHEN v >= 0 THEN (v + 4) >> 3 ELSE -((4 - v) >> 3) END AS half_away FROM (SELECT x - y AS v FROM pts)")
def prj21_roundings(s, d):
    v = F.col("v")
    return points(s, d, "x", "y").select((F.col("x") - F.col("y")).alias("v")).select("v", E.shift_toward_zero(v, 3).alias("toward_zero"), E.shift_half_up(v, 3).alias("half_up"), E.shift_half_away(v, 3).alias("half_away"))


@query(P + """, t AS (SELECT CAST(x AS BIGINT) AS a, CAST(y + 1 AS BIGINT) AS b, greatest(0, CAST(length(bin(y+1)) AS INT) - 8) AS n FROM pts),
u AS (SELECT a, b, n, (b + ((1::BIGINT << n) >> 1)) >> n AS top FROM t)
SELECT a, b, (((131072 + top) // (2*top)) * a) >> (n + 16 - 8) AS q FROM u""")
def prj22_div_approx(s, d):
    a, b = F.col("x").cast("bigint"), (F.col("y") + 1).cast("bigint")
    return points(s, d, "x", "y").select(a.alias("a"), b.alias("b")).select("a", "b", E.div_approx(F.col("a"), F.col("b"), 8).alias("q"))



@query(P + """SELECT refl, qp, step, refl * step AS scaled, (refl * (67108864 // step) + 22369621) >> 26 AS level FROM (
SELECT CAST(refl AS BIGINT) AS refl, qp, CAST([161,181,203,228,256,287][greatest(qp,4) % 6 + 1] AS BIGINT) << (greatest(qp,4) // 6) AS step FROM (SELECT refl, laser * 7 AS qp FROM pts))""")
def prj24_attribute_quantiser(s, d):
    p = points(s, d, "refl", "laser").select(F.col("refl").cast("bigint").alias("refl"), (F.col("laser") * 7).alias("qp"))
    p = p.withColumn("step", E.attribute_step(F.col("qp")))
    level = F.shiftright(F.col("refl") * E.idiv(F.lit(1 << 26), F.col("step")) + (1 << 26) // 3, 26)
    return p.select("refl", "qp", "step", (F.col("refl") * F.col("step")).alias("scaled"), level.alias("level"))


@query(P + "SELECT x, qp, (x * (CAST(8 + qp % 8 AS BIGINT) << (qp >> 3)) + 4) >> 3 AS scaled FROM (SELECT x, laser * 5 AS qp FROM pts)")
def prj25_geometry_scale(s, d):
    p = points(s, d, "x", "laser").select("x", (F.col("laser") * 5).alias("qp"))
    return p.withColumn("scaled", E.geometry_scaled(F.col("x"), F.col("qp")))


@query(P + "SELECT x, (x & ~15) + ((((x & 15) * 8 + 4) >> 3) & 15) AS rebuilt, x & ~15 AS node FROM pts")
def prj26_in_tree_quantisation(s, d):
    x = F.col("x")
    low = E.geometry_scaled(x.bitwiseAND(15), F.lit(0)).bitwiseAND(F.lit(15).cast("bigint"))
    return points(s, d, "x").select("x", (x.bitwiseAND(~15) + low).alias("rebuilt"), x.bitwiseAND(~15).alias("node"))


HALF_AWAY = "CASE WHEN {v} >= 0 THEN ({v} + 32768) >> 16 ELSE -((32768 - ({v})) >> 16) END"


def _moved(when: str) -> str:
    row = lambda r: f"(CAST(m{r}0 AS BIGINT)*x + CAST(m{r}1 AS BIGINT)*y + CAST(m{r}2 AS BIGINT)*z)"
    cols = ", ".join(f"CAST(CASE WHEN m00 IS NOT NULL{when} THEN {HALF_AWAY.format(v=row(r))} + t{r} ELSE {a} END AS INT) AS {a}" for r, a in enumerate("xyz"))
    return FR + f", {SQL_MOTION} SELECT idx, frames.frame, {cols} FROM frames LEFT JOIN motion ON frames.frame = motion.frame"


@query(_moved(" AND (z < z_bottom OR z > z_top)"))
def prj27_motion_outside_band(s, d):
    return project.apply_motion(frames(s, d).select("idx", "frame", "x", "y", "z"), motion(s))


@query(_moved(""))
def prj27_motion_all(s, d):
    return project.apply_motion(frames(s, d).select("idx", "frame", "x", "y", "z"), motion(s), only_outside=False)


@query(P + "SELECT x & ~7 AS x, y & ~7 AS y, z & ~7 AS z FROM pts")
def prj29_node_corner(s, d):
    return points(s, d, "x", "y", "z").select(*(F.col(a).bitwiseAND(~7).alias(a) for a in "xyz"))


@query(P + "SELECT x, y, z, 128 AS c0, 128 AS c1, 128 AS c2, 0 AS refl FROM pts")
def prj30_default_attributes(s, d):
    return points(s, d, "x", "y", "z").withColumns({"c0": F.lit(128), "c1": F.lit(128), "c2": F.lit(128), "refl": F.lit(0)})


@query(P + "SELECT x, y, z, refl FROM pts")
def prj31_keep_attributes(s, d):
    return points(s, d).drop("c0", "c1", "c2", "laser")


@query(S3 + """SELECT a.idx AS i, b.idx AS j, CAST(a.x-b.x AS BIGINT)*(a.x-b.x) + CAST(a.y-b.y AS BIGINT)*(a.y-b.y) + CAST(a.z-b.z AS BIGINT)*(a.z-b.z) AS l2,
 abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z) AS l1, greatest(abs(a.x-b.x), abs(a.y-b.y), abs(a.z-b.z)) AS linf FROM emb3 a JOIN emb3 b ON b.idx = a.idx + 1""")
def prj32_norms(s, d):
    p = small_points(s, d).select("idx", "x", "y", "z")
    q = p.select((F.col("idx") - 1).alias("idx"), *(F.col(a).alias(f"q{a}") for a in "xyz"))
    gaps = [F.abs(F.col(a) - F.col(f"q{a}")) for a in "xyz"]
    return p.join(q, "idx").select(F.col("idx").alias("i"), (F.col("idx") + 1).alias("j"), E.distance2(*((F.col(a), F.col(f"q{a}")) for a in "xyz")).alias("l2"), sum(gaps[1:], gaps[0]).alias("l1"), F.greatest(*gaps).alias("linf"))


@query(P + "SELECT x, y, z FROM pts WHERE x BETWEEN 100 AND 500 AND y BETWEEN 200 AND 900 AND z BETWEEN 0 AND 1200")
def flt01_in_box(s, d):
    return filters.in_box(points(s, d, "x", "y", "z"), (100, 200, 0), (500, 900, 1200))


SQL_TILES = "boxes AS (SELECT x // 128 AS tile, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts GROUP BY 1)"


@query(P + f", {SQL_TILES} SELECT CAST(a.tile AS BIGINT) AS a, CAST(b.tile AS BIGINT) AS b FROM boxes a, boxes b WHERE a.tile < b.tile AND a.max_x + 130 >= b.min_x AND a.min_x <= b.max_x + 130 AND a.max_y >= b.min_y AND a.min_y <= b.max_y AND a.max_z >= b.min_z AND a.min_z <= b.max_z")
def flt02_box_intersections(s, d):
    p = points(s, d, "x", "y", "z").withColumn("tile", E.idiv(F.col("x"), 128))
    return filters.intersecting(reduce.bounding_box(p, "tile"), "tile", margin_x=130)


@query(FR + ", b AS (SELECT frame, slice, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM frames GROUP BY 1, 2) SELECT b.frame, b.slice, f.idx, x, y, z FROM frames f JOIN b ON b.frame = f.frame + 1 WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1")
def flt03_crop_reference(s, d):
    f = frames(s, d)
    # each slice of a frame has the whole frame before it as its reference
    reference = f.select((F.col("frame") + 1).alias("frame"), "idx", "x", "y", "z").join(f.select("frame", "slice").distinct(), "frame")
    return filters.crop(reference.select("frame", "slice", "idx", "x", "y", "z"), f, by=("frame", "slice"))


@query(FR + "SELECT idx, z < 20 OR z > 150 AS is_object FROM frames")
def flt04_road_objects(s, d):
    return frames(s, d).select("idx", filters.is_object(20, 150).alias("is_object"))


@query(FR + "SELECT idx, x, y, z FROM frames WHERE frame = 7")
def flt05_one_frame(s, d):
    return frames(s, d).filter("frame = 7").select("idx", "x", "y", "z")


@query(FR + ", m AS (SELECT frame, m00, m01, m10, t0, t1, t2 FROM (VALUES " + MOTION_ROWS + f") AS t({MOTION_NAMES})) SELECT frame, NOT (m00 > 65535 AND abs(t0) < 250 AND abs(t1) < 250 AND abs(t2) < 250) AS moving FROM m")
def flt08_motion_status(s, d):
    return filters.motion_status(motion(s), 250).select("frame", "moving")


@query(P + ", n AS (SELECT x >> 6 AS nx, y >> 6 AS ny, z >> 6 AS nz, CAST(count(*) AS BIGINT) AS n, count(DISTINCT x*4194304*4096 + y*4096 + z) AS d FROM (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM pts) GROUP BY 1, 2, 3) SELECT CAST(nx AS INT) AS nx, CAST(ny AS INT) AS ny, CAST(nz AS INT) AS nz, n, n <= 2 OR d = 1 AS direct FROM n")
def flt13_direct_mode(s, d):
    return filters.direct_mode(points(s, d, "x", "y", "z"), 6)
