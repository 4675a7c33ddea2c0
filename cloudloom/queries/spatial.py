"""Join, recolour, level-of-detail, transform, octree and sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators import hierarchy, joins, kernels, lod, recolour, reduce
from cloudloom.plans import schedules
from cloudloom.queries.aggregates import SQL_OCC
from cloudloom.queries.projections import sql_morton
from cloudloom.queries.registry import query
from cloudloom.sources.clouds import SQL_FRAMES, SQL_INDEXED, SQL_POINTS, SQL_SMALL, frames, indexed_points, points, small_points
from cloudloom.sources.shared import staged

P, I, FR, S3 = f"WITH {SQL_POINTS} ", f"WITH {SQL_INDEXED} ", f"WITH {SQL_FRAMES} ", f"WITH {SQL_SMALL} "
LASERS = [(0, 0), (1, 400), (2, 700), (3, 1100), (4, 1500), (5, 1900), (6, 2300)]
REGIONS = [(0, 100, 0, 0, 400, 900, 1200, 4), (1, 200, 300, 200, 800, 1500, 2000, -3), (2, 0, 0, 0, 2000, 2000, 600, 7)]
SQL_LASERS = "lasers AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in LASERS) + ") AS t(l, theta))"
SQL_REGIONS = "regions AS (SELECT * FROM (VALUES " + ", ".join(map(str, REGIONS)) + ") AS t(ord, ax, ay, az, bx, by_, bz, qp))"


def d2(a: str, b: str) -> str:
    return " + ".join(f"CAST({a}.{x}-{b}.{x} AS BIGINT)*({a}.{x}-{b}.{x})" for x in "xyz")


SQL_HALVES = "tgt AS (SELECT idx, x, y, z FROM emb3 WHERE idx % 2 = 1), src AS (SELECT idx, x, y, z, label*25 AS c0, (label*40) % 256 AS c1, (label*77) % 256 AS c2 FROM emb3 WHERE idx % 2 = 0)"


def sql_knn(t: str, s: str, k: int) -> str:
    return f"SELECT t, s, d2, rank FROM (SELECT t.idx AS t, s.idx AS s, {d2('t', 's')} AS d2, CAST(row_number() OVER (PARTITION BY t.idx ORDER BY {d2('t', 's')}, s.idx) AS INT) AS rank FROM {t} t, {s} s) WHERE rank <= {k}"


def halves(s, d):
    p = small_points(s, d)
    src = p.filter("idx % 2 = 0").select("idx", "x", "y", "z", (F.col("label") * 25).alias("c0"), (F.col("label") * 40 % 256).alias("c1"), (F.col("label") * 77 % 256).alias("c2"))
    return p.filter("idx % 2 = 1").select("idx", "x", "y", "z"), src


@query(S3 + f", {SQL_HALVES} {sql_knn('tgt', 'src', 8)}")
def jn01_top01_knn(s, d):
    t, src = halves(s, d)
    return joins.knn_join(t, src, 8)


@query(S3 + f", {SQL_HALVES} SELECT s AS t, count(*) AS votes, min(d2) AS least FROM ({sql_knn('src', 'tgt', 2)}) GROUP BY 1")
def jn02_reverse_knn(s, d):
    t, src = halves(s, d)
    back = joins.knn_join(src, t, 2)
    return back.groupBy(F.col("s").alias("t")).agg(F.count(F.lit(1)).alias("votes"), F.min("d2").alias("least"))


def with_reference(s, d):
    """The frames, and each frame as the reference of the next one."""
    f = frames(s, d)
    return f, f.withColumn("frame", F.col("frame") + 1)


@query(FR + f"SELECT t, s, d2, rank FROM (SELECT t.idx AS t, s.idx AS s, {d2('t', 's')} AS d2, CAST(row_number() OVER (PARTITION BY t.idx ORDER BY {d2('t', 's')}, s.idx) AS INT) AS rank FROM frames t JOIN frames s ON s.frame = t.frame - 1) WHERE rank <= 3")
def jn01_knn_between_frames(s, d):
    f, reference = with_reference(s, d)
    return joins.knn_join(f, reference, 3, by=("frame",))


@query(I + ", q AS (SELECT idx, CAST(round(x*0.125) AS INT) AS qx, CAST(round(y*0.125) AS INT) AS qy, CAST(round(z*0.125) AS INT) AS qz FROM pts), r AS (SELECT qx, qy, qz, min(idx) AS dst FROM q GROUP BY 1, 2, 3) SELECT dst, idx AS src FROM q JOIN r USING (qx, qy, qz)")
def jn03_dedup_back_map(s, d):
    q = indexed_points(s, d, "x", "y", "z").select("idx", *(E.quantise(a, 0.125).alias(f"q{a}") for a in "xyz"))
    r = q.groupBy("qx", "qy", "qz").agg(F.min("idx").alias("dst"))
    return q.join(r, ["qx", "qy", "qz"]).select("dst", F.col("idx").alias("src"))


@query(I + "SELECT p.idx, p.x, p.y, p.z FROM pts p JOIN (SELECT idx FROM pts WHERE laser = 2) g USING (idx)")
def jn04_index_gather(s, d):
    p = indexed_points(s, d, "x", "y", "z", "laser")
    return p.join(p.filter("laser = 2").select("idx"), "idx").select("idx", "x", "y", "z")


SQL_ASOF = FR + ", r AS (SELECT frame + 1 AS frame, refl, y, min(idx) AS idx FROM frames GROUP BY 1, 2, 3), t AS (SELECT idx, frame, refl, y FROM frames), m AS (SELECT t.idx, t.frame, t.refl, t.y, r.idx AS ref_id, r.y AS ref_by, row_number() OVER (PARTITION BY t.idx ORDER BY r.y) AS k FROM t LEFT JOIN r ON r.frame = t.frame AND r.refl = t.refl AND r.y > t.y) "


@query(SQL_ASOF + "SELECT idx, frame, refl, y, ref_id, CAST(ref_by AS BIGINT) AS ref_by FROM m WHERE k = 1")
def jn05_asof_next(s, d):
    f, reference = with_reference(s, d)
    return joins.asof_next(f.select("idx", "frame", "refl", "y"), reference, ["frame", "refl"], "y")


@query(SQL_ASOF + ", n AS (SELECT DISTINCT idx, frame, refl, y FROM t) SELECT n.idx, n.frame, n.refl, n.y, m.ref_id, CAST(m.ref_by AS BIGINT) AS ref_by FROM n LEFT JOIN m ON m.idx = n.idx AND m.k = 2")
def jn05_asof_next_next(s, d):
    f, reference = with_reference(s, d)
    return joins.asof_next(f.select("idx", "frame", "refl", "y"), reference, ["frame", "refl"], "y", skip=1)


@query(FR + "SELECT frame, slice, y // 600 AS phi, min(idx) AS idx FROM frames GROUP BY 1, 2, 3")
def jn06_asof_insert_first_wins(s, d):
    return frames(s, d).groupBy("frame", "slice", E.idiv(F.col("y"), 600).alias("phi")).agg(F.min("idx").alias("idx"))


@query(FR + "SELECT frame, slice, y // 600 AS phi, min(z) AS radius, arg_min(idx, row(z, idx)) AS idx FROM frames GROUP BY 1, 2, 3")
def jn07_smallest_radius(s, d):
    return kernels.smallest_radius(frames(s, d), ["frame", "slice"], 600).select("frame", "slice", "phi", "radius", "idx")


SQL_SETS = """own AS (SELECT frame, slice, y // 600 AS phi, arg_min(y, idx) AS y, min(idx) AS idx FROM frames GROUP BY 1, 2, 3),
rf AS (SELECT frame + 1 AS frame, slice, y // 600 AS phi, arg_min(y, row(z, idx)) AS y, min(z) AS r FROM frames GROUP BY 1, 2, 3),
n AS (SELECT o.frame, o.slice, o.phi, o.y, o.idx, arg_min(struct_pack(y := rf.y, r := rf.r), rf.phi) FILTER (WHERE rf.phi = o.phi) AS e,
  arg_min(struct_pack(y := rf.y, r := rf.r), rf.phi) FILTER (WHERE rf.phi > o.phi) AS nx, arg_max(struct_pack(y := rf.y, r := rf.r), rf.phi) FILTER (WHERE rf.phi < o.phi) AS pv
  FROM own o JOIN rf USING (frame, slice) GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT *, CASE WHEN e IS NOT NULL THEN e WHEN nx IS NOT NULL THEN nx ELSE pv END AS a, CASE WHEN e IS NOT NULL THEN CASE WHEN e.y < y THEN coalesce(nx, e) WHEN e.y > y THEN coalesce(pv, e) ELSE e END ELSE coalesce(pv, nx) END AS b FROM n),
g AS (SELECT frame, slice, phi, idx, a.r AS ar, CAST(a.y - b.y AS BIGINT) AS da, CAST(a.r - b.r AS BIGINT) AS dr, CAST(y - a.y AS BIGINT) AS dy FROM c)"""


@query(FR + f", {SQL_SETS} SELECT frame, slice, phi, idx, CAST(CASE WHEN da = 0 OR dr = 0 THEN ar ELSE ar + CASE WHEN dr * dy * da > 0 THEN 1 ELSE -1 END * ((abs(dr * dy) + (abs(da) >> 1)) // abs(da)) END AS BIGINT) AS radius FROM g")
def jn08_resampled_radius(s, d):
    f, reference = with_reference(s, d)
    return kernels.resampled(f, reference, ["frame", "slice"], 600)


@query(I + f", {SQL_LASERS} SELECT idx, arg_min(l, row(abs(z - theta), l)) AS nearest FROM pts, lasers GROUP BY 1")
def jn09_nearest_laser(s, d):
    lasers = s.createDataFrame(LASERS, "l int, theta int")
    return joins.nearest_value(indexed_points(s, d, "z"), F.col("z"), lasers, "theta", "l", "nearest").select("idx", "nearest")


@query(P + f", {SQL_REGIONS} SELECT x, y, z, coalesce((SELECT arg_min(qp, ord) FROM regions WHERE x BETWEEN ax AND bx AND y BETWEEN ay AND by_ AND z BETWEEN az AND bz), 0) AS qp FROM pts")
def jn10_first_region(s, d):
    regions = s.createDataFrame(REGIONS, "ord int, min_x int, min_y int, min_z int, max_x int, max_y int, max_z int, qp int")
    return joins.first_box(points(s, d, "x", "y", "z"), regions, "qp", 0)


@query(FR + ", o AS (SELECT DISTINCT frame + 1 AS frame, CAST(floor((x + dx)/64.0) AS BIGINT) AS bx, CAST(floor((y + dy)/64.0) AS BIGINT) AS by_, CAST(floor((z + dz)/64.0) AS BIGINT) AS bz FROM frames, (SELECT unnest([-20, 20]) AS dx), (SELECT unnest([-20, 20]) AS dy), (SELECT unnest([-20, 20]) AS dz)) SELECT idx, f.frame, x, y, z FROM frames f JOIN o ON o.frame = f.frame AND o.bx = CAST(floor(f.x/64.0) AS BIGINT) AND o.by_ = CAST(floor(f.y/64.0) AS BIGINT) AND o.bz = CAST(floor(f.z/64.0) AS BIGINT)")
def jn11_near_blocks(s, d):
    f, reference = with_reference(s, d)
    return joins.near_blocks(f.select("idx", "frame", "x", "y", "z"), reference, 64, 20, by=("frame",))


SQL_L1 = "n AS (SELECT t.idx, min(abs(t.x-s.x)+abs(t.y-s.y)+abs(t.z-s.z)) AS d1 FROM (SELECT * FROM emb3 WHERE idx % 2 = 1) t, (SELECT * FROM emb3 WHERE idx % 2 = 0) s GROUP BY 1)"


@query(S3 + f", {SQL_L1} SELECT idx, d1 FROM n WHERE d1 * (SELECT count(*) FROM n) <= 2 * (SELECT sum(d1) FROM n)")
def jn12_l1_nearest_residual_filter(s, d):
    t, src = halves(s, d)
    return kernels.l1_inliers(t, src)


@query(FR + f", a AS (SELECT frame, level, {sql_morton('x', 'y >> 1', 'z')} >> level AS node, count(*) AS w, CAST(sum(refl) AS BIGINT) AS v FROM frames, (SELECT unnest([15, 18, 21, 24, 27]) AS level) GROUP BY 1, 2, 3) SELECT a.frame, a.level, a.node, a.w, a.v, b.w AS ref_w, b.v AS ref_v FROM a JOIN a b ON b.frame = a.frame - 1 AND b.level = a.level AND b.node = a.node")
def jn13_hierarchies_at_level(s, d):
    return hierarchy.joined_levels(frames(s, d).withColumn("y", F.shiftright("y", 1)), "refl", [15, 18, 21, 24, 27])


SQL_FACES = ", n AS (SELECT DISTINCT x >> 6 AS nx, y >> 6 AS ny, z >> 6 AS nz FROM pts), s AS (SELECT * FROM (VALUES (1,0,0,1),(-1,0,0,2),(0,1,0,4),(0,-1,0,8),(0,0,1,16),(0,0,-1,32)) AS t(dx, dy, dz, bit)) "


@query(P + SQL_FACES + ", m AS (SELECT n.nx, n.ny, n.nz, sum(CASE WHEN o.nx IS NULL THEN 0 ELSE bit END) AS mask FROM n CROSS JOIN s LEFT JOIN n o ON o.nx = n.nx + dx AND o.ny = n.ny + dy AND o.nz = n.nz + dz GROUP BY 1, 2, 3) SELECT nx, ny, nz, CAST(mask AS INT) AS mask FROM m")
def jn19_face_neighbours(s, d):
    return joins.node_neighbours(points(s, d, "x", "y", "z"), 6)


@query(S3 + f", {SQL_HALVES} SELECT t, s, l1, rank FROM (SELECT t.idx AS t, s.idx AS s, abs(t.x-s.x)+abs(t.y-s.y)+abs(t.z-s.z) AS l1, CAST(row_number() OVER (PARTITION BY t.idx ORDER BY abs(t.x-s.x)+abs(t.y-s.y)+abs(t.z-s.z), s.idx) AS INT) AS rank FROM tgt t JOIN src s ON abs((t.x >> 7) - (s.x >> 7)) <= 1 AND abs((t.y >> 7) - (s.y >> 7)) <= 1 AND abs((t.z >> 7) - (s.z >> 7)) <= 1) WHERE rank <= 3")
def jn17_lod_neighbours_first_stage(s, d):
    t, src = halves(s, d)
    return kernels.cell_neighbours(t, src, 7, 3)


@query(S3 + f", {SQL_HALVES}, e AS ({sql_knn('tgt', 'src', 3)}), m AS (SELECT t, min(d2) AS near FROM e GROUP BY 1) SELECT e.t, s, d2, rank FROM e JOIN m USING (t) WHERE rank = 1 OR d2 <= 2500")
def flt09_prune_far_neighbours(s, d):
    t, src = halves(s, d)
    return joins.knn_join(t, src, 3).filter("rank = 1 or d2 <= 2500")



@query(S3 + f", {SQL_HALVES}, e AS ({sql_knn('tgt', 'src', 3)}) SELECT t, max(c0)-min(c0) AS spread, max(c0)-min(c0) >= 64 AS eligible FROM e JOIN src ON src.idx = e.s GROUP BY 1")
def flt11_mode_eligibility(s, d):
    t, src = halves(s, d)
    e = joins.knn_join(t, src, 3).join(src.select(F.col("idx").alias("s"), "c0"), "s").groupBy("t").agg((F.max("c0") - F.min("c0")).alias("spread"))
    return e.withColumn("eligible", F.col("spread") >= 64)


SQL_FWD = f"""fk AS ({sql_knn('tgt', 'src', 8)}), fw AS (SELECT t, min(d2) AS least, {', '.join(f"arg_min(c{i}, row(d2, s)) AS f{i}, round(sum(c{i} / (d2 + 4.0::DOUBLE)) / sum(1.0::DOUBLE / (d2 + 4.0::DOUBLE)), 9) AS m{i}" for i in range(3))} FROM fk JOIN src ON src.idx = fk.s GROUP BY 1),
fv AS (SELECT t, {', '.join(f"CASE WHEN least = 0 THEN CAST(f{i} AS DOUBLE) ELSE least(greatest(round(m{i}), 0.0), 255.0) END AS w{i}" for i in range(3))} FROM fw)"""
SQL_BACK = f"""bk AS ({sql_knn('src', 'tgt', 1)}), bv AS (SELECT s AS t, count(*) AS n, {', '.join(f"CAST(sum(c{i}) AS BIGINT) AS s{i}, CAST(sum(CAST(c{i} AS BIGINT)*c{i}) AS BIGINT) AS q{i}, round(round(sum(c{i} / (sqrt(CAST(d2 AS DOUBLE)) + 4.0::DOUBLE)) / sum(1.0::DOUBLE / (sqrt(CAST(d2 AS DOUBLE)) + 4.0::DOUBLE)), 9)) AS c{i}" for i in range(3))} FROM bk JOIN src ON src.idx = bk.t GROUP BY 1)"""
SQL_TRY = f"""o AS (SELECT i, j, k, (i+1)*9 + (j+1)*3 + k + 1 AS o FROM (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), (SELECT unnest([-1,0,1]) AS k)),
tr AS (SELECT fv.t, o, n, s0, s1, s2, q0, q1, q2, w0, w1, w2, {', '.join(f"least(greatest(c{a} + {x}, 0.0::DOUBLE), 255.0::DOUBLE) AS v{a}" for a, x in enumerate('ijk'))} FROM fv JOIN bv USING (t), o),
er AS (SELECT *, greatest(({' + '.join(f'(v{a}-w{a})*(v{a}-w{a})' for a in range(3))}) / nt, ({' + '.join(f'(n*v{a}*v{a} - 2*v{a}*s{a} + q{a})' for a in range(3))}) / ns) AS e FROM tr, (SELECT CAST(count(*) AS DOUBLE) AS nt FROM tgt), (SELECT CAST(count(*) AS DOUBLE) AS ns FROM src)),
pk AS (SELECT t, o, v0, v1, v2 FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY e, o) AS r FROM er) WHERE r = 1)"""


@query(S3 + f", {SQL_HALVES}, {SQL_FWD}, {SQL_BACK}, {SQL_TRY} SELECT fv.t AS idx, {', '.join(f'CAST(coalesce(v{a}, w{a}) AS INT) AS c{a}' for a in range(3))} FROM fv LEFT JOIN pk USING (t)")
def recolour_colour(s, d):
    t, src = halves(s, d)
    return recolour.recolour(t, src, ["c0", "c1", "c2"])


SQL_LATTICE = f"""tt AS (SELECT idx, (x + 5)*2 AS x, (y - 3)*2 AS y, (z + 2)*2 AS z FROM tgt), ss AS (SELECT idx, x*3 AS x, y*3 AS y, z*3 AS z FROM src),
f1 AS (SELECT t, s, rank, d2 / 9.0::DOUBLE AS d2, c1 AS v FROM ({sql_knn('tt', 'ss', 8)}) k JOIN src ON src.idx = k.s WHERE rank = 1 OR d2 / 9.0::DOUBLE <= 400),
f2 AS (SELECT * FROM (SELECT *, min(d2) OVER (PARTITION BY t) AS least FROM f1) WHERE rank = 1 OR least >= 0.0001),
f3 AS (SELECT * FROM (SELECT *, (max(v) OVER w - min(v) OVER w) AS g FROM f2 WINDOW w AS (PARTITION BY t ORDER BY rank)) WHERE g*g <= 300),
fw AS (SELECT t, CASE WHEN count(*) = 1 THEN CAST(any_value(v) AS DOUBLE) ELSE least(greatest(round(round(sum(v / (d2 + 4.0::DOUBLE)) / sum(1.0::DOUBLE / (d2 + 4.0::DOUBLE)), 9)), 0.0), 255.0) END AS w FROM f3 GROUP BY 1),
b1 AS (SELECT s AS t, t AS s, d2 / 4.0::DOUBLE AS d2, c1 AS v FROM ({sql_knn('ss', 'tt', 2)}) k JOIN src ON src.idx = k.t WHERE d2 / 4.0::DOUBLE <= 400),
b2 AS (SELECT *, (max(v) OVER w - min(v) OVER w) AS g FROM b1 WINDOW w AS (PARTITION BY t ORDER BY d2, s ROWS UNBOUNDED PRECEDING)),
bv AS (SELECT t, count(*) AS n, CAST(sum(v) AS BIGINT) AS sv, CAST(sum(CAST(v AS BIGINT)*v) AS BIGINT) AS qv, least(greatest(round(round(sum(v / (sqrt(d2) + 4.0::DOUBLE)) / sum(1.0::DOUBLE / (sqrt(d2) + 4.0::DOUBLE)), 9)), 0.0), 255.0) AS c FROM b2 WHERE g*g <= 300 GROUP BY 1),
tr AS (SELECT fw.t, o, n, sv, qv, w, least(greatest(c + o, 0.0::DOUBLE), 255.0::DOUBLE) AS v FROM fw JOIN bv USING (t), (SELECT unnest([-2, -1, 0, 1, 2]) AS o)),
pk AS (SELECT t, arg_min(v, row(greatest((v-w)*(v-w) / nt, (n*v*v - 2*v*sv + qv) / ns), o)) AS v FROM tr, (SELECT CAST(count(*) AS DOUBLE) AS nt FROM tgt), (SELECT CAST(count(*) AS DOUBLE) AS ns FROM src) GROUP BY 1)"""


@query(S3 + f", {SQL_HALVES}, {SQL_LATTICE} SELECT fw.t AS idx, CAST(coalesce(v, w) AS INT) AS c1 FROM fw LEFT JOIN pk USING (t)")
def recolour_reflectance(s, d):
    """One component, the source at three halves of its scale and moved, with limits on distances of place and of value."""
    t, src = halves(s, d)
    how = [recolour.Direction(8, most_distance2=400, most_attribute2=300), recolour.Direction(2, same_place_only=False, most_distance2=400, most_attribute2=300)]
    return recolour.recolour(t, src, ["c1"], *how, search=2, scale=(3, 2), offset=(5, -3, 2))


@query(S3 + f", {SQL_HALVES}, a AS ({sql_knn('tgt', 'src', 1)}), b AS ({sql_knn('src', 'tgt', 1)}) SELECT round(x, 6) AS mse_ab, round(y, 6) AS mse_ba, round(greatest(x, y), 6) AS mse, greatest(p, q) AS hausdorff, round(10.0::DOUBLE * log10(3.0::DOUBLE*1023*1023 / greatest(x, y)), 6) AS psnr FROM (SELECT avg(d2) AS x, max(d2) AS p FROM a), (SELECT avg(d2) AS y, max(d2) AS q FROM b)")
def d1_distortion(s, d):
    t, src = halves(s, d)
    m = recolour.distortion(t, src, 1023.0)
    return m.select(*(F.round(c, 6).alias(c) for c in ("mse_ab", "mse_ba", "mse")), "hausdorff", F.round("psnr", 6).alias("psnr"))


SQL_CELL = ", c AS (SELECT idx, x, y, z, x >> 5 AS cx, y >> 5 AS cy, z >> 5 AS cz, CAST((x >> 4) << 4 AS BIGINT) AS px, CAST((y >> 4) << 4 AS BIGINT) AS py, CAST((z >> 4) << 4 AS BIGINT) AS pz, " + sql_morton("x", "y", "z") + " AS m FROM pts), u AS (SELECT cx, cy, cz, count(*) AS n, sum(px) AS sx, sum(py) AS sy, sum(pz) AS sz FROM c GROUP BY 1, 2, 3)"


@query(I + SQL_CELL + " SELECT cx, cy, cz, arg_min(idx, row(CAST(abs(px*n-sx)+abs(py*n-sy)+abs(pz*n-sz) AS BIGINT), m, idx)) AS idx, count(*) AS n FROM c JOIN u USING (cx, cy, cz) GROUP BY 1, 2, 3")
def lod05_centroid_sample(s, d):
    return lod.centroid_sample(indexed_points(s, d, "x", "y", "z"), 4)


SQL_W = f"""e AS ({sql_knn('tgt', 'src', 3)}), p AS (SELECT t, max(CASE WHEN rank = 1 THEN d2 END) AS a, max(CASE WHEN rank = 2 THEN d2 END) AS b, max(CASE WHEN rank = 3 THEN d2 END) AS c FROM e GROUP BY 1),
g AS (SELECT *, CAST(greatest(0, CASE WHEN a > 0 THEN length(bin(a)) - 8 ELSE 0 END) AS INT) AS n FROM p),
h AS (SELECT t, (a + ((1::BIGINT << n) >> 1)) >> n AS a, (b + ((1::BIGINT << n) >> 1)) >> n AS b, (c + ((1::BIGINT << n) >> 1)) >> n AS c FROM g),
k AS (SELECT *, CASE WHEN c IS NOT NULL AND c < a*256 THEN 3 WHEN b IS NOT NULL AND b < a*256 THEN 2 ELSE 1 END AS cnt, greatest(a+b, 1) AS s2, greatest(b*c + a*c + a*b, 1) AS s3 FROM h),
l AS (SELECT *, CAST(greatest(0, length(bin(s2)) - 8) AS INT) AS n2, CAST(greatest(0, length(bin(s3)) - 8) AS INT) AS n3 FROM k),
r AS (SELECT *, (131072 + ((s2 + ((1::BIGINT << n2) >> 1)) >> n2)) // (2 * ((s2 + ((1::BIGINT << n2) >> 1)) >> n2)) AS r2, (131072 + ((s3 + ((1::BIGINT << n3) >> 1)) >> n3)) // (2 * ((s3 + ((1::BIGINT << n3) >> 1)) >> n3)) AS r3 FROM l)"""


@query(S3 + f", {SQL_HALVES}, {SQL_W} SELECT t AS idx, cnt AS n, CASE cnt WHEN 3 THEN 256 - ((r3*a*c) >> (n3+8)) - ((r3*a*b) >> (n3+8)) WHEN 2 THEN 256 - ((r2*a) >> (n2+8)) ELSE 256 END AS w0, CASE cnt WHEN 3 THEN (r3*a*c) >> (n3+8) WHEN 2 THEN (r2*a) >> (n2+8) ELSE 0 END AS w1, CASE cnt WHEN 3 THEN (r3*a*b) >> (n3+8) ELSE 0 END AS w2 FROM r")
def lod06_predictor_weights(s, d):
    t, src = halves(s, d)
    return lod.predictor_weights(joins.knn_join(t, src, 3))


@query(P + "SELECT w0, w1, w2, (w0*10 + w1*(6-b2) + w2*b3) >> 4 AS v0, (w0*b1 + w1*10 + w2*(6-b3)) >> 4 AS v1, 256 - ((w0*10 + w1*(6-b2) + w2*b3) >> 4) - ((w0*b1 + w1*10 + w2*(6-b3)) >> 4) AS v2 FROM (SELECT c0 AS w0, 255-c0 AS w1, 1 AS w2, CASE WHEN x <= y THEN 1 ELSE 5 END AS b1, CASE WHEN x <= z THEN 5 ELSE 1 END AS b2, CASE WHEN y <= z THEN 1 ELSE 5 END AS b3 FROM pts)")
def lod07_blended_weights(s, d):
    p = points(s, d, "x", "y", "z", "c0").select("x", "y", "z", F.col("c0").alias("w0"), (255 - F.col("c0")).alias("w1"), F.lit(1).alias("w2"))
    w = lod.blended_weights((F.col("w0"), F.col("w1"), F.col("w2")), F.col("x"), F.col("y"), F.col("z"))
    return p.select("w0", "w1", "w2", *(e.alias(f"v{i}") for i, e in enumerate(w)))


@query(S3 + f", {SQL_HALVES}, e AS ({sql_knn('tgt', 'src', 3)}) SELECT t AS idx, (CAST(sum(c0) AS BIGINT) * 85 + 128) >> 8 AS predicted FROM e JOIN src ON src.idx = e.s GROUP BY 1")
def lod08_predicted_colour(s, d):
    t, src = halves(s, d)
    e = joins.knn_join(t, src, 3).join(src.select(F.col("idx").alias("s"), "c0"), "s")
    return e.groupBy(F.col("t").alias("idx")).agg(E.shift_half_away(F.sum("c0") * 85, 8).alias("predicted"))


def _small_cloud(s, d):
    return small_points(s, d).select("idx", "x", "y", "z", (F.col("label") * 25).alias("v"))


@query()
def lod09_lod10_lifting_coefficients(s, d):
    return lod.lifting(_small_cloud(s, d), "v", most_levels=6)[0]


@query(S3 + "SELECT idx, CAST(label*25 AS BIGINT) AS value FROM emb3")
def lod09_lod10_lifting_round_trip(s, d):
    return lod.inverse_lifting(*lod.lifting(_small_cloud(s, d), "v", most_levels=6)).select("idx", "value")


@query(I + f", m AS (SELECT idx, row_number() OVER (ORDER BY {sql_morton('x', 'y', 'z')}, idx) - 1 AS place FROM pts) SELECT 5 - " + " - ".join(f"CAST(place % {4**k} = 0 AS INT)" for k in range(1, 6)) + " AS lod, count(*) AS n FROM m GROUP BY 1")
def lod01_levels(s, d):
    return lod.levels(indexed_points(s, d, "x", "y", "z"), 4, 6).groupBy("lod").agg(F.count(F.lit(1)).alias("n"))


@query()
def lod03_distance_sample(s, d):
    return lod.distance_sample(frames(s, d), "frame", 3)



@query(P + f"SELECT {sql_morton('x >> 3', 'y >> 3', 'z >> 3')} AS morton, count(*) AS weight, CAST(sum(refl) AS BIGINT) AS value FROM pts GROUP BY 1")
def raht01_merge_equal(s, d):
    p = points(s, d, "x", "y", "z", "refl")
    return p.groupBy(E.morton(*(F.shiftright(a, 3) for a in "xyz")).alias("morton")).agg(F.count(F.lit(1)).alias("weight"), F.sum("refl").alias("value"))


@query(P + f"SELECT {sql_morton('x', 'y', 'z')} >> 7 AS morton, count(*) AS weight, CAST(sum(refl) AS BIGINT) AS value FROM pts GROUP BY 1")
def raht02_one_level(s, d):
    p = points(s, d, "x", "y", "z", "refl").select(E.morton("x", "y", "z").alias("morton"), F.lit(1).cast("bigint").alias("weight"), F.col("refl").cast("bigint").alias("value"))
    return hierarchy.raht_level(p, 7)


@query(P + "SELECT w0, w1, round((sqrt(w0/(w0+w1))*c0 + sqrt(w1/(w0+w1))*c1), 6) AS lf, round((sqrt(w0/(w0+w1))*c1 - sqrt(w1/(w0+w1))*c0), 6) AS hf FROM (SELECT CAST(laser + 1 AS DOUBLE) AS w0, CAST(refl + 1 AS DOUBLE) AS w1, c0, c1 FROM pts)")
def raht04_butterfly(s, d):
    p = points(s, d, "laser", "refl", "c0", "c1").select((F.col("laser") + 1).cast("double").alias("w0"), (F.col("refl") + 1).cast("double").alias("w1"), "c0", "c1")
    a, b = F.sqrt(F.col("w0") / (F.col("w0") + F.col("w1"))), F.sqrt(F.col("w1") / (F.col("w0") + F.col("w1")))
    return p.select("w0", "w1", F.round(a * F.col("c0") + b * F.col("c1"), 6).alias("lf"), F.round(a * F.col("c1") - b * F.col("c0"), 6).alias("hf"))


@query(P + "SELECT c0, c1, c1 - c0 AS h, c0 + ((c1 - c0) >> 1) AS l FROM pts")
def raht05_integer_haar(s, d):
    h = F.col("c1") - F.col("c0")
    return points(s, d, "c0", "c1").select("c0", "c1", h.alias("h"), (F.col("c0") + F.shiftright(h, 1)).alias("l"))


def _halved(s, d):
    """Frames with y in 16 bits, which the SQL's addresses need."""
    return frames(s, d).withColumn("y", F.shiftright("y", 1))


@query(FR + f", b AS (SELECT {sql_morton('x', 'y >> 1', 'z')} AS m, count(*) AS w, CAST(sum(refl) AS BIGINT) AS s FROM frames GROUP BY 1), c AS (SELECT lv*3 AS level, m >> (lv*3) AS m, sum(w) AS w, sum(s) AS s FROM b, (SELECT CAST(unnest(range(0, 3)) AS INT) AS lv) GROUP BY 1, 2) SELECT level, m >> 3 AS node, " + ", ".join(f"CAST(sum(CASE WHEN m & 7 = {i} THEN w ELSE 0 END) AS BIGINT) AS w{i}, CAST(sum(CASE WHEN m & 7 = {i} THEN s ELSE 0 END) AS BIGINT) AS s{i}" for i in range(8)) + " FROM c GROUP BY 1, 2")
def raht06_blocks(s, d):
    return hierarchy.raht_blocks(_halved(s, d), [0, 3, 6], "refl")





@query(FR + f", b AS (SELECT {sql_morton('x >> 3', 'y >> 10', 'z >> 4')} AS m, count(*) AS w, CAST(sum(refl) AS BIGINT) AS s FROM frames GROUP BY 1) SELECT m, CAST(w AS DOUBLE) AS w, CAST(s AS DOUBLE) AS s FROM b")
def raht03_raht09_inverse_transform(s, d):
    df = frames(s, d).select(F.shiftright("x", 3).alias("x"), F.shiftright("y", 10).alias("y"), F.shiftright("z", 4).alias("z"), "refl")
    blocks = staged(hierarchy.raht_blocks(df, [3 * k for k in range(8)], "refl"), "blocks")
    out = hierarchy.inverse_raht(blocks, staged(hierarchy.raht_of(blocks, 8), "raht"), 8)
    return out.select("m", "w", F.round("s", 4).alias("s"))


@query(P + "SELECT level, nx, ny, nz, n, occupancy FROM (SELECT lv + 1 AS level, x >> (lv+1) AS nx, y >> (lv+1) AS ny, z >> (lv+1) AS nz, count(*) AS n, bit_or(1 << (4*((x >> lv) & 1) + 2*((y >> lv) & 1) + ((z >> lv) & 1))) AS occupancy FROM pts, (SELECT CAST(unnest(range(0, 12)) AS INT) AS lv) GROUP BY 1, 2, 3, 4, lv) ")
def oct01_octree(s, d):
    return hierarchy.octree(points(s, d, "x", "y", "z"), 12)


@query(P + "SELECT DISTINCT x, y, z FROM pts")
def oct02_octree_round_trip(s, d):
    nodes = staged(hierarchy.octree(points(s, d, "x", "y", "z"), 16), "octree")
    return hierarchy.decode_octree(nodes, 16)


@query(P + "SELECT x >> a AS nx, y >> b AS ny, z >> c AS nz, count(*) AS n FROM pts, (SELECT 5 AS a, 5 AS b, 5 AS c) GROUP BY 1, 2, 3")
def oct03_uneven_split(s, d):
    left = [11, 12, 11]
    for split in hierarchy.split_schedule((11, 12, 11), max_first=1)[:7]:
        left = [v - q for v, q in zip(left, split, strict=True)]
    return points(s, d, "x", "y", "z").groupBy(*(F.shiftright(a, k).alias(f"n{a}") for a, k in zip("xyz", left, strict=True))).agg(F.count(F.lit(1)).alias("n"))


@query(P + "SELECT (x & ~15) + 8 AS x, (y & ~15) + 8 AS y, (z & ~15) + 8 AS z, count(*) AS n FROM pts GROUP BY 1, 2, 3")
def oct04_cell_centres(s, d):
    return hierarchy.cell_centres(points(s, d, "x", "y", "z"), 4)


@query(P + f", o AS ({SQL_OCC.format(t='pts')}) SELECT level, nx, ny, nz, CAST(occupancy & 240 = 0 OR occupancy & 15 = 0 AS BOOLEAN) AS planar_x, CAST(occupancy & 204 = 0 OR occupancy & 51 = 0 AS BOOLEAN) AS planar_y, CAST(occupancy & 170 = 0 OR occupancy & 85 = 0 AS BOOLEAN) AS planar_z FROM o")
def oct05_oct06_planar_nodes(s, d):
    o, b = reduce.occupancy(points(s, d, "x", "y", "z"), [2, 4, 6]), F.col("occupancy")
    flat = lambda m: (b.bitwiseAND(m) == 0) | (b.bitwiseAND(255 - m) == 0)
    return o.select("level", "nx", "ny", "nz", flat(240).alias("planar_x"), flat(204).alias("planar_y"), flat(170).alias("planar_z"))


@query(I + ", f AS (SELECT laser, z > 1200 AS object, idx FROM pts), p AS (SELECT *, lag(idx) OVER (PARTITION BY laser, object ORDER BY idx) AS parent FROM f), r AS (SELECT laser, object, min(idx) AS root FROM f GROUP BY 1, 2), c AS (SELECT *, lag(root) OVER (PARTITION BY object ORDER BY laser) AS up FROM r) SELECT p.idx, coalesce(p.parent, c.up) AS parent FROM p JOIN c USING (laser, object)")
def prd02_angular_tree(s, d):
    return kernels.angular_tree(indexed_points(s, d, "z", "laser"))




@query()
def win09_srt06_lidar_order(s, d):
    return kernels.serpentine(frames(s, d), "frame", "slice")


@query()
def agg20_motion_estimate(s, d):
    f, reference = with_reference(s, d)
    return kernels.estimate_motion(reference, f)



@query(FR + "SELECT a.frame, a.idx, b.n_ref FROM frames a JOIN (SELECT frame, count(*) AS n_ref FROM frames GROUP BY 1) b ON b.frame = a.frame - 1")
def str07_previous_frame_state(s, d):
    f = frames(s, d)
    prev = f.groupBy("frame").agg(F.count(F.lit(1)).alias("n_ref")).select((F.col("frame") + 1).alias("frame"), "n_ref")
    return f.select("frame", "idx").join(prev, "frame")


@query(FR + "SELECT CAST(frame // 8 AS BIGINT) AS period, count(*) AS n, count(DISTINCT frame) AS frames FROM frames GROUP BY 1")
def str03_random_access_periods(s, d):
    return frames(s, d).groupBy(E.idiv(F.col("frame"), 8).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frame").alias("frames"))


@query("""WITH RECURSIVE g(l, r, shift, path) AS (SELECT 0, 8, 0, '' UNION ALL
SELECT CASE WHEN b = 0 THEN l ELSE (l+r)//2 END, CASE WHEN b = 0 THEN (l+r)//2 ELSE r END, shift + 1, path || (b+1) FROM g, (SELECT unnest([0, 1]) AS b) WHERE r - l >= 4)
SELECT row_number() OVER (ORDER BY path) - 1 AS code_order, (l+r)//2 AS frame, l AS ref0, r AS ref1, shift + 1 AS qp_shift FROM g""")
def str04_str05_hierarchical_schedule(s, d):
    return s.createDataFrame(schedules.hierarchical(0, 8, 1), "code_order long, frame int, ref0 int, ref1 int, qp_shift int")


@query(FR + "SELECT slice, max(frame) AS frame, arg_max(refl, row(frame, idx)) AS payload FROM frames GROUP BY 1")
def str08_latest_parameter_set(s, d):
    g = frames(s, d).groupBy("slice").agg(F.max("frame").alias("frame"), F.max_by("refl", F.struct("frame", "idx")).alias("payload"))
    return g


@query(FR + ", m AS (SELECT frame, CAST(round(avg(x)) AS INT) AS cx FROM frames GROUP BY 1) SELECT a.frame, count(*) AS n FROM frames a JOIN m USING (frame) WHERE abs(a.x - m.cx) <= 16 GROUP BY 1")
def str01_per_frame_pipeline(s, d):
    f = frames(s, d)
    m = f.groupBy("frame").agg(F.round(F.avg("x")).cast("int").alias("cx"))
    return f.join(m, "frame").filter(F.abs(F.col("x") - F.col("cx")) <= 16).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


