"""Queries of prediction, transforms with prediction, trees, slices, motion, and the formats and options around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators import filters, hierarchy, joins, kernels, lod, motion, partition, prediction, reduce, slices, trees
from cloudloom.plans import options as plan_options
from cloudloom.plans import schedules
from cloudloom.queries.projections import sql_morton
from cloudloom.queries.registry import query
from cloudloom.queries.spatial import SQL_HALVES, halves, sql_knn
from cloudloom.sources import records
from cloudloom.sources.clouds import SQL_FRAMES, SQL_INDEXED, SQL_POINTS, SQL_SMALL, frames, indexed_points, points, small_points
from cloudloom.sources.shared import scratch, staged
from cloudloom.streaming import frames as stream

P, I, FR, S3 = f"WITH {SQL_POINTS} ", f"WITH {SQL_INDEXED} ", f"WITH {SQL_FRAMES} ", f"WITH {SQL_SMALL} "
AXES = "xyz"
QP, QP_CHROMA, PERIOD, LEVELS = 28, 34, 4, 4


def small_cloud(s, d):
    return small_points(s, d).select("idx", "x", "y", "z", (F.col("label") * 25).alias("v"))


# --- prediction of attributes


def sql_level(x: str, qp: int) -> str:
    inverse, third = (1 << 26) // E.ATTRIBUTE_STEPS[qp % 6] >> qp // 6, (1 << 26) // 3
    return f"(CASE WHEN ({x}) >= 0 THEN (CAST({x} AS BIGINT) * {inverse} + {third}) >> 26 ELSE -(({third} - CAST({x} AS BIGINT) * {inverse}) >> 26) END)"


def sql_scaled(level: str, qp: int) -> str:
    return f"(({level} * {E.ATTRIBUTE_STEPS[qp % 6] << qp // 6} + 128) >> 8)"


WEIGHTS = (3, -2)
_PRED = ", ".join(f"(CAST(sum(s.c{i}) AS BIGINT) * 85 + 128) >> 8 AS p{i}" for i in range(3))
SQL_COLOUR = f"e AS ({sql_knn('tgt', 'src', 3)}), p AS (SELECT e.t AS idx, {_PRED} FROM e JOIN src s ON s.idx = e.s GROUP BY 1), v AS (SELECT p.*, label*25 AS c0, (label*40) % 256 AS c1, (label*77) % 256 AS c2 FROM p JOIN emb3 USING (idx)), q AS (SELECT *, {sql_level('(c0 - p0) * 256', QP)} AS r0 FROM v), f AS (SELECT *, {sql_scaled('r0', QP)} AS first FROM q)"


@query(S3 + f", {SQL_HALVES}, {SQL_COLOUR} SELECT idx, r0, " + ", ".join(sql_level(f"(c{k} - p{k} - ((first * {w} + 2) >> 2)) * 256", QP_CHROMA) + f" AS r{k}" for k, w in zip((1, 2), WEIGHTS, strict=True)) + " FROM f")
def lod13_colour_residuals(s, d):
    t, src = halves(s, d)
    near = joins.knn_join(t, src, 3).join(src.select(F.col("idx").alias("s"), "c0", "c1", "c2"), "s")
    p = near.groupBy(F.col("t").alias("idx")).agg(*(E.shift_half_away(F.sum(f"c{i}") * 85, 8).alias(f"p{i}") for i in range(3)))
    own = small_points(s, d).select("idx", (F.col("label") * 25).alias("c0"), (F.col("label") * 40 % 256).alias("c1"), (F.col("label") * 77 % 256).alias("c2"))
    return prediction.colour_residuals(p.join(own, "idx"), ["c0", "c1", "c2"], ["p0", "p1", "p2"], QP, QP_CHROMA, WEIGHTS).select("idx", "r0", "r1", "r2")


@query()
def lod11_lod12_predicting_transform(s, d):
    return prediction.predicting_transform(small_cloud(s, d), "v", QP, PERIOD, LEVELS)[0]


@query(S3 + "SELECT idx, true AS same, true AS within FROM emb3")
def lod11_lod12_decoded(s, d):
    """What the residuals alone give is what the coder had, and lies within a step of the values."""
    coded, edges = prediction.predicting_transform(small_cloud(s, d), "v", QP, PERIOD, LEVELS)
    again = prediction.from_residuals(coded.select("idx", "lod", "mode", "residual"), edges, QP).withColumnRenamed("reconstructed", "again")
    step = E.ATTRIBUTE_STEPS[QP % 6] * (1 << QP // 6) / 256
    both = coded.join(again, "idx").join(small_cloud(s, d).select("idx", "v"), "idx")
    return both.select("idx", (F.col("again") == F.col("reconstructed")).alias("same"), (F.abs(F.col("v") - F.col("again")) <= step).alias("within"))


@query()
def agg16_quantisation_weights(s, d):
    cloud = small_cloud(s, d)
    return prediction.propagated_weights(cloud, lod.lifting(cloud, "v", PERIOD, LEVELS)[1])


SQL_PLACED = f"m AS (SELECT idx, x, y, z, row_number() OVER (ORDER BY {sql_morton('x', 'y', 'z')}, idx) - 1 AS place FROM emb3), f AS (SELECT * FROM m WHERE place % 4 <> 0), c AS (SELECT *, place // 4 AS r FROM m WHERE place % 4 = 0)"
_L1 = "abs(f.x-c.x)+abs(f.y-c.y)+abs(f.z-c.z)"
_CELLS = " AND ".join(f"abs((f.{a} >> 6) - (c.{a} >> 6)) <= 1" for a in AXES)


@query(S3 + f", {SQL_PLACED}, a AS (SELECT t, s, l1 FROM (SELECT f.idx AS t, c.idx AS s, {_L1} AS l1, row_number() OVER (PARTITION BY f.idx ORDER BY {_L1}, c.idx) AS k FROM f JOIN c ON {_CELLS}) WHERE k <= 3), n AS (SELECT idx FROM f WHERE idx NOT IN (SELECT t FROM a GROUP BY 1 HAVING count(*) >= 3)), b AS (SELECT f.idx AS t, c.idx AS s, {_L1} AS l1 FROM f JOIN n USING (idx) JOIN c ON abs(c.r - f.place // 4) <= 5), u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT t, s, l1, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY l1, s) AS INT) AS rank FROM u) WHERE rank <= 3")
def jn17_lod_neighbours_with_window(s, d):
    return prediction.window_neighbours(staged(lod.levels(small_cloud(s, d), PERIOD, 2), "lod"), 1, PERIOD, 2, 6, 5)


SQL_SIX = "e AS (SELECT * FROM (SELECT t.idx AS t, s.idx AS s, abs(t.x-s.x)+abs(t.y-s.y)+abs(t.z-s.z) AS l1, 4*CAST(s.x >= t.x AS INT) + 2*CAST(s.y >= t.y AS INT) + CAST(s.z >= t.z AS INT) AS dir, row_number() OVER (PARTITION BY t.idx ORDER BY abs(t.x-s.x)+abs(t.y-s.y)+abs(t.z-s.z), s.idx) AS rank FROM tgt t JOIN src s ON " + " AND ".join(f"abs((t.{a} >> 8) - (s.{a} >> 8)) <= 1" for a in AXES) + ") WHERE rank <= 6)"
_HAM = lambda a, b: f"bit_count(xor({a}, {b}))"
SQL_SPREAD = f"""g AS (SELECT t, {', '.join(f'max(CASE WHEN rank = {i + 1} THEN dir END) AS d{i}, max(CASE WHEN rank = {i + 1} THEN s END) AS s{i}' for i in range(3))}, max(CASE WHEN rank = 3 THEN l1 END) AS l2, count(*) AS n FROM e GROUP BY 1),
h AS (SELECT g.t, arg_min(e.s, e.rank) FILTER (WHERE {_HAM('e.dir', 'd0')} = 3 OR {_HAM('e.dir', 'd1')} = 3) AS across, arg_min(e.s, e.rank) FILTER (WHERE {_HAM('e.dir', 'd0')} = 2) AS loose, arg_min(e.s, e.rank) FILTER (WHERE e.dir <> d0 AND e.dir <> d1) AS other FROM g JOIN e ON e.t = g.t AND e.rank > 3 AND e.l1 * 32 < l2 * 54 GROUP BY 1)"""


@query(S3 + f", {SQL_HALVES}, {SQL_SIX}, {SQL_SPREAD} SELECT g.t, s0, s1, CASE WHEN n < 4 OR {_HAM('d0', 'd1')} = 3 OR {_HAM('d0', 'd2')} = 3 OR {_HAM('d1', 'd2')} = 3 THEN s2 ELSE coalesce(across, CASE WHEN d0 = d1 AND d0 = d2 THEN loose WHEN d0 = d1 AND {_HAM('d2', 'd0')} <> 2 THEN loose WHEN d0 <> d1 AND (d2 = d0 OR d2 = d1) AND {_HAM('d1', 'd0')} <> 2 THEN other END, s2) END AS s2 FROM g LEFT JOIN h USING (t)")
def top02_spread_neighbours(s, d):
    t, src = halves(s, d)
    six = kernels.cell_neighbours(t, src, 8, 6)
    at = lambda df, k, p: df.select(F.col("idx").alias(k), *(F.col(a).alias(f"{p}{a}") for a in AXES))
    both = six.join(at(t, "t", "t"), "t").join(at(src, "s", "s"), "s")
    return prediction.spread_out(both.withColumn("dir", prediction.direction(*(F.col(f"s{a}") - F.col(f"t{a}") for a in AXES))))


@query(I + f", m AS (SELECT idx, row_number() OVER (ORDER BY {sql_morton('x', 'y', 'z')}, idx) - 1 AS place FROM pts) SELECT 'period' AS method, count(*) AS n FROM m WHERE place % 5 = 0 UNION ALL SELECT 'centroid', count(*) FROM (SELECT DISTINCT x >> 6, y >> 6, z >> 6 FROM pts)")
def lod02_sampling_methods(s, d):
    p = indexed_points(s, d, "x", "y", "z")
    kept = [lod.sampled(p, m, **o).select(F.lit(m).alias("method")) for m, o in (("period", {"period": 5}), ("centroid", {"bits": 5}))]
    return kept[0].unionByName(kept[1]).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


# --- transforms with prediction


def coarse(s, d):
    """The frames as one cloud at a coarser scale, within 2^DEPTH on each axis."""
    return frames(s, d).select(F.shiftright("x", 3).alias("x"), F.shiftright("y", 10).alias("y"), F.shiftright("z", 4).alias("z"), "refl")


DEPTH = 8
SQL_16 = "b AS (SELECT x >> 3 AS x, y >> 10 AS y, z >> 4 AS z, refl FROM frames), n AS (SELECT x, y, z, CAST(sum(refl) AS DOUBLE) / count(*) AS v FROM b GROUP BY 1, 2, 3)"
_STEPS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if abs(i) + abs(j) + abs(k) < 3]
_LOOK = "l AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {k}, {(4, 2, 1)[abs(i) + abs(j) + abs(k)]}, {sum(1 << c for c in range(8) if all(not e or (c >> 2 - a & 1) == (e > 0) for a, e in enumerate((i, j, k))))})" for i, j, k in _STEPS) + ") AS t(i, j, k, w, mask))"


@query(FR + f", {SQL_16}, {_LOOK} SELECT {sql_morton('a.x', 'a.y', 'a.z')} AS node, " + ", ".join(f"round(sum(CASE WHEN mask & {1 << c} > 0 THEN w * o.v END) / sum(CASE WHEN mask & {1 << c} > 0 THEN w END), 6) AS p{c}" for c in range(8)) + " FROM n a, l JOIN n o ON o.x = a.x + i AND o.y = a.y + j AND o.z = a.z + k WHERE mask = 255 OR (10 * o.v > 2 * a.v AND 10 * o.v < 25 * a.v) GROUP BY 1")
def raht07_upsampled_prediction(s, d):
    nodes = frames(s, d).groupBy(E.morton(F.shiftright("x", 3), F.shiftright("y", 10), F.shiftright("z", 4)).alias("node")).agg((F.sum("refl") / F.count(F.lit(1))).alias("v"))
    return hierarchy.upsampled(nodes).select("node", *(F.round(f"p{i}", 6).alias(f"p{i}") for i in range(8)))


@query(FR + f" SELECT {sql_morton('x >> 3', 'y >> 10', 'z >> 4')} AS m, CAST(count(*) AS DOUBLE) AS w, true AS within FROM frames GROUP BY 1")
def raht08_predicted_round_trip(s, d):
    """Every place's weight, and whether its mean comes back within what the quantiser allows."""
    df = coarse(s, d)
    _, rebuilt = hierarchy.raht_predicted(df, "refl", DEPTH, 4)
    mean = df.groupBy(E.morton(*AXES).alias("m")).agg(F.avg("refl").alias("mean"))
    return rebuilt.join(joins.apart(mean), "m").select("m", "w", (F.abs(F.col("v") - F.col("mean")) <= 6).alias("within"))


@query()
def raht10_attributes(s, d):
    df = coarse(s, d).withColumn("tone", F.pmod(F.col("x") * 7, F.lit(256)))
    return hierarchy.raht_attributes(df, ["refl", "tone"], DEPTH, 16)


def _to_root(s, d):
    """The transform without prediction of the frames at a coarser scale, up to the root."""
    return hierarchy.raht(coarse(s, d), "refl", DEPTH)


@query()
def raht12_zeroed_levels(s, d):
    c = _to_root(s, d).filter("band > 0").withColumn("place", F.col("node") * 8 + F.col("band"))
    return hierarchy.zeroed(c.withColumn("key", F.col("level").cast("string")), "key", 40)


def _sql_butterflies() -> str:
    """All levels of weighted butterflies over ``b`` (m, w, s), each step a query; coefficients are unioned."""
    steps = []
    level = [f"{c} AS (SELECT m, CAST(count(*) AS DOUBLE) AS w, CAST(sum(refl) AS DOUBLE) AS s FROM q GROUP BY 1)" for c in ("b0",)]
    steps += level
    for k in range(DEPTH):
        steps.append(f"k{k} AS (SELECT m >> 3 AS node, " + ", ".join(f"coalesce(sum(CASE WHEN m & 7 = {i} THEN w END), 0.0::DOUBLE) AS w{i}, sum(CASE WHEN m & 7 = {i} THEN s END) AS s{i}" for i in range(8)) + f" FROM b{k} GROUP BY 1)")
        steps.append(f"c{k}_0 AS (SELECT node, " + ", ".join(f"w{i}, CASE WHEN w{i} > 0 THEN s{i} / sqrt(w{i}) END AS c{i}" for i in range(8)) + f" FROM k{k})")
        for j, pairs in enumerate(hierarchy.STEPS):
            cols = []
            for a, b in pairs:
                both = f"(w{a} > 0 AND w{b} > 0)"
                cols.append(f"CASE WHEN {both} THEN sqrt(w{a}/(w{a}+w{b}))*c{a} + sqrt(w{b}/(w{a}+w{b}))*c{b} ELSE coalesce(c{a}, c{b}) END AS c{a}, CASE WHEN {both} THEN sqrt(w{a}/(w{a}+w{b}))*c{b} - sqrt(w{b}/(w{a}+w{b}))*c{a} END AS c{b}, w{a}+w{b} AS w{a}, CASE WHEN {both} THEN w{a}+w{b} ELSE 0.0 END AS w{b}")
            steps.append(f"c{k}_{j + 1} AS (SELECT node, {', '.join(cols)} FROM c{k}_{j})")
        steps.append(f"b{k + 1} AS (SELECT node AS m, " + " + ".join(f"w{i}" for i in range(8)) + " AS w, " + " + ".join(f"coalesce(s{i}, 0.0::DOUBLE)" for i in range(8)) + f" AS s FROM k{k})")
    rows = " UNION ALL ".join(f"SELECT {3 * k} AS level, node, {i} AS band, c{i} AS coefficient FROM c{k}_3 WHERE c{i} IS NOT NULL" for k in range(DEPTH) for i in range(8) if i or k == DEPTH - 1)
    return ", ".join(steps) + f" SELECT level, node, band, round(coefficient, 5) AS coefficient FROM ({rows})"


@query(FR + f", q AS (SELECT {sql_morton('x >> 3', 'y >> 10', 'z >> 4')} AS m, refl FROM frames), " + _sql_butterflies())
def raht08_raht11_transform_to_root(s, d):
    return _to_root(s, d).select("level", "node", "band", F.round("coefficient", 5).alias("coefficient"))


# --- octree


@query(P + "SELECT level, nx, ny, nz, c AS child, CAST((((occupancy >> xor(c, 4)) & 1) << ((c >> 2) & 1)) | (((occupancy >> xor(c, 2)) & 1) << (2 + (1 - ((c >> 1) & 1)))) | (((occupancy >> xor(c, 1)) & 1) << (4 + (1 - (c & 1)))) AS INT) AS pattern FROM (SELECT 4 AS level, x >> 5 AS nx, y >> 5 AS ny, z >> 5 AS nz, bit_or(1 << (4*((x >> 4) & 1) + 2*((y >> 4) & 1) + ((z >> 4) & 1))) AS occupancy FROM pts GROUP BY 2, 3, 4), (SELECT CAST(unnest(range(0, 8)) AS INT) AS c) WHERE (occupancy >> c) & 1 = 1")
def oct05_sibling_patterns(s, d):
    return hierarchy.sibling_patterns(reduce.occupancy(points(s, d, "x", "y", "z"), [4]))


@query(I + f", f AS (SELECT x, y, z, min(idx) AS idx, count(*) AS n FROM pts GROUP BY 1, 2, 3), g AS (SELECT x >> 6 AS a, y >> 6 AS b, z >> 6 AS c, count(*) <= 2 AS direct FROM pts GROUP BY 1, 2, 3) SELECT idx, direct, row_number() OVER (ORDER BY CASE WHEN direct THEN 0 ELSE 1 END, {sql_morton('x', 'y', 'z')}) - 1 AS place FROM f JOIN g ON x >> 6 = a AND y >> 6 = b AND z >> 6 = c")
def oct10_output_order(s, d):
    return slices.tree_order(indexed_points(s, d, "x", "y", "z"), 6)


SQL_OCC4 = "o AS (SELECT frame, x >> 5 AS nx, y >> 13 AS ny, z >> 6 AS nz, bit_or(1 << (4*((x >> 4) & 1) + 2*((y >> 12) & 1) + ((z >> 5) & 1))) AS occ FROM frames GROUP BY 1, 2, 3, 4)"


@query(FR + f", {SQL_OCC4}, m AS (SELECT a.frame, a.nx, a.ny, a.nz, bit_count(xor(a.occ, b.occ)) AS before, bit_count(xor(a.occ, c.occ)) AS behind_ FROM o a LEFT JOIN o b ON b.frame = a.frame - 1 AND b.nx = a.nx AND b.ny = a.ny AND b.nz = a.nz LEFT JOIN o c ON c.frame = a.frame + 1 AND c.nx = a.nx AND c.ny = a.ny AND c.nz = a.nz) SELECT frame, nx, ny, nz, CAST(before AS INT) AS missed_before, CAST(behind_ AS INT) AS missed_behind, coalesce(before >= behind_, before IS NULL) AS behind FROM m WHERE before IS NOT NULL OR behind_ IS NOT NULL")
def oct09_reference_choice(s, d):
    f = frames(s, d).select("frame", "x", F.shiftright("y", 8).alias("y"), F.shiftright("z", 1).alias("z"))
    return motion.reference_choice(f, 4)


@query(FR + ", m AS (SELECT * FROM (VALUES (0), (1)) AS t(k)) SELECT 'none' AS source, count(*) AS n, true AS nearer FROM frames UNION ALL SELECT 'estimated', count(*), true FROM frames WHERE frame < (SELECT max(frame) FROM frames)")
def oct11_motion_sources(s, d):
    """The points that each source of motion gives, and whether the estimated motion brings the reference at least as near to its partners in the mean as none."""
    f = frames(s, d)
    reference = f.withColumn("frame", F.col("frame") + 1)
    pair = staged(joins.knn_join(f, reference, 1, by=("frame",)).select("t", "s"), "pairs")
    moved = staged(motion.moved_reference(reference, f, "estimated", near=pair), "moved")
    at = lambda df, k, p: df.select(F.col("idx").alias(k), *(F.col(a).alias(f"{p}{a}") for a in AXES))
    gap = lambda ref: pair.join(joins.apart(at(f, "t", "t")), "t").join(joins.apart(at(ref, "s", "s")), "s").agg(F.avg(E.distance2(*((F.col(f"t{a}"), F.col(f"s{a}")) for a in AXES))).alias("g"))
    nearer = gap(moved).crossJoin(gap(reference).withColumnRenamed("g", "h")).select((F.col("g") <= F.col("h") + 1).alias("nearer"))
    none = motion.moved_reference(f, f, "none").agg(F.lit("none").alias("source"), F.count(F.lit(1)).alias("n"), F.lit(True).alias("nearer"))
    return none.unionByName(moved.agg(F.lit("estimated").alias("source"), F.count(F.lit(1)).alias("n")).crossJoin(nearer))


_BLOCK = ", ".join(f"CAST(floor({a} / 4096.0) AS BIGINT) AS c{a}" for a in AXES)


@query(FR + f", o AS (SELECT frame, idx, x, y, z, {_BLOCK} FROM frames), p AS (SELECT *, row_number() OVER (PARTITION BY frame, cx, cy, cz ORDER BY idx) - 1 AS r, 1 + (count(*) OVER (PARTITION BY frame, cx, cy, cz) >> 6) AS period FROM o), s AS (SELECT * FROM p WHERE r % period = 0),"
  " e AS (SELECT s.frame, s.cx, s.cy, s.cz, s.idx, s.period, least(min(abs(s.x-w.x)+abs(s.y-w.y)+abs(s.z-w.z)), 1024) AS d FROM s JOIN frames w ON w.frame = s.frame - 1 AND " + " AND ".join(f"(s.c{a} = CAST(floor((w.{a} - 512) / 4096.0) AS BIGINT) OR s.c{a} = CAST(floor(w.{a} / 4096.0) AS BIGINT) OR s.c{a} = CAST(floor((w.{a} + 512) / 4096.0) AS BIGINT))" for a in AXES) + " GROUP BY 1, 2, 3, 4, 5, 6),"
  " g AS (SELECT *, greatest(0, length(bin(d + 1)) - 6) AS k FROM e) SELECT frame, cx, cy, cz, count(*) AS samples, CAST(period * sum(16*k + CAST(round(16 * log2(CAST((d + 1) >> CAST(k AS INT) AS DOUBLE))) AS INT)) AS BIGINT) AS cost FROM g GROUP BY 1, 2, 3, 4, period")
def agg21_block_costs(s, d):
    f = frames(s, d)
    return motion.block_costs(f, f.withColumn("frame", F.col("frame") + 1), 4096, 512)


# --- prediction trees


SQL_CHAIN = "f AS (SELECT laser, z > 1200 AS object, idx, x, y, z FROM pts), p AS (SELECT *, lag(idx) OVER (PARTITION BY laser, object ORDER BY idx) AS parent FROM f), r AS (SELECT laser, object, min(idx) AS root FROM f GROUP BY 1, 2), c AS (SELECT *, lag(root) OVER (PARTITION BY object ORDER BY laser) AS up FROM r), t AS (SELECT p.idx, p.x, p.y, p.z, coalesce(p.parent, c.up) AS parent FROM p JOIN c USING (laser, object))"
_BITS = lambda e: f"(2*length(bin(abs({e}) + 1)) - 1)"
_GUESS = [["0"] * 3, [f"p0.{a}" for a in AXES], [f"2*p0.{a} - p1.{a}" for a in AXES], [f"p0.{a} + p1.{a} - p2.{a}" for a in AXES]]
_TRY = ", ".join(f"CASE WHEN {('true', 'p0.idx IS NOT NULL', 'p1.idx IS NOT NULL', 'p2.idx IS NOT NULL')[m]} THEN row(" + " + ".join(_BITS(f"CAST(t.{a} - ({e}) AS BIGINT)") for a, e in zip(AXES, g, strict=True)) + f", {m}, " + ", ".join(f"CAST(t.{a} - ({e}) AS BIGINT)" for a, e in zip(AXES, g, strict=True)) + ") END" for m, g in enumerate(_GUESS))


@query(I + f", {SQL_CHAIN}, k AS (SELECT t.idx, t.parent, list_min(list_filter([{_TRY}], lambda v: v IS NOT NULL)) AS b FROM t LEFT JOIN t p0 ON p0.idx = t.parent LEFT JOIN t p1 ON p1.idx = p0.parent LEFT JOIN t p2 ON p2.idx = p1.parent) SELECT idx, parent, CAST(b[2] AS INT) AS mode, b[3] AS rx, b[4] AS ry, b[5] AS rz, CAST(b[1] AS INT) AS bits FROM k")
def prd03_tree_residuals(s, d):
    p = indexed_points(s, d, "x", "y", "z", "laser")
    tree = p.select("idx", "x", "y", "z").join(kernels.angular_tree(p), "idx")
    return trees.residuals(tree, "idx").select("idx", "parent", "mode", "rx", "ry", "rz", "bits")


@query(FR + "SELECT idx, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM frames")
def prd04_prd05_trees_decoded(s, d):
    """Trees of chunks in Morton order, coded by modes and residuals, and decoded from these alone."""
    coded = staged(trees.residuals(trees.trees(frames(s, d), 512)), "tree")
    points_ = trees.decoded(coded.select("chunk", "place", "parent", "mode", "rx", "ry", "rz"))
    return points_.join(coded.select("place", "idx"), "place").select("idx", "x", "y", "z")


@query()
def prd01_jn21_nearest_tree(s, d):
    return trees.trees(frames(s, d), 1000, "radius").select("chunk", "idx", "place", "parent")


# --- slices


@query()
def prt07_refined_slices(s, d):
    return partition.refined_slices(indexed_points(s, d, "x", "y", "z"), (128, 256, 256), 700)


@query(I + ", g AS (SELECT CAST(floor(x/128.0) AS BIGINT) AS gx, CAST(floor(y/256.0) AS BIGINT) AS gy, CAST(floor(z/256.0) AS BIGINT) AS gz, count(*) AS n FROM pts GROUP BY 1, 2, 3) SELECT (SELECT count(*) FROM pts) AS points, true AS all_within, (SELECT CAST(coalesce(sum(ceil(n / 700.0)), 0) AS BIGINT) FROM g WHERE n > 700) AS split_parts, true AS dense")
def prt07_refined_slices_hold(s, d):
    """All points are placed, no slice is over the limit, large cells make their parts, and numbers are dense."""
    cut = staged(prt07_refined_slices(s, d), "refined")
    n = cut.groupBy("slice_id").agg(F.count(F.lit(1)).alias("n"))
    p = indexed_points(s, d, "x", "y", "z").select("idx", *(F.floor(F.col(a) / w).alias(f"g{a}") for a, w in zip(AXES, (128, 256, 256), strict=True)))
    large = p.groupBy("gx", "gy", "gz").agg(F.count(F.lit(1)).alias("c")).filter("c > 700")
    parts = p.join(large, ["gx", "gy", "gz"]).join(cut.select("idx", "slice_id"), "idx").select("slice_id").distinct()
    one = n.agg(F.sum("n").alias("points"), (F.max("n") <= 700).alias("all_within"), (F.max("slice_id") + 1 == F.count(F.lit(1))).alias("dense"))
    return one.crossJoin(parts.agg(F.count(F.lit(1)).alias("split_parts")))


@query(FR + ", b AS (SELECT frame, min(x) AS x, min(y) AS y, min(z) AS z FROM frames GROUP BY 1) SELECT a.frame, least(a.x, c.x) AS min_x, least(a.y, c.y) AS min_y, least(a.z, c.z) AS min_z FROM b a JOIN b c ON c.frame = a.frame - 1")
def prt09_least_origin(s, d):
    box = reduce.bounding_box(frames(s, d), "frame")
    return partition.least_origin(box, box.withColumn("frame", F.col("frame") + 1), "frame")


@query(P + "SELECT CAST(x // 16 AS INT) AS slice_id, count(*) AS n FROM pts WHERE x < 4096 GROUP BY 1")
def flt06_occupied_slices(s, d):
    p = points(s, d, "x").filter("x < 4096").select(E.idiv(F.col("x"), 16).cast("int").alias("slice_id"))
    return partition.occupied(p, "slice_id", 256)


@query(I + f", m AS (SELECT x, y, z, row_number() OVER (ORDER BY {sql_morton('x', 'y', 'z')}, idx) - 1 AS place FROM pts) SELECT CAST(level AS INT) AS level, place // CAST(power(32, level + 1) AS BIGINT) AS bucket, count(*) AS n, " + ", ".join(f"{f}({a}) AS {f}_{a}" for a in AXES for f in ("min", "max")) + " FROM m, (SELECT unnest([0, 1, 2]) AS level) GROUP BY 1, 2")
def jn18_box_hierarchy(s, d):
    return partition.box_hierarchy(indexed_points(s, d, "x", "y", "z"))


@query(I + f"SELECT idx, row_number() OVER (PARTITION BY laser ORDER BY {sql_morton('x', 'y', 'z')}, idx) - 1 AS place FROM pts")
def srt04_chunk_address_order(s, d):
    """Each chunk in address order, with the ties that an unstable sort would leave open in order of idx."""
    keyed = indexed_points(s, d, "x", "y", "z", "laser").select("idx", "laser", E.morton(*AXES).alias("address"))
    return partition.place_within(keyed, ["laser"], ["address", "idx"]).select("idx", "place")


@query(I + f", m AS (SELECT idx, row_number() OVER (ORDER BY {sql_morton('x', 'y', 'z')}, idx) - 1 AS place FROM pts) SELECT lod, count(*) AS n, true AS same FROM (SELECT 2 - CAST(place % 4 = 0 AS INT) - CAST(place % 16 = 0 AS INT) AS lod FROM m) GROUP BY 1")
def lod14_level_cache(s, d):
    """Levels from a cache: asked for again with equal parameters they are the same table."""
    cache, p = lod.LevelCache(), indexed_points(s, d, "x", "y", "z")
    one, two = cache.levels("points", p, 4, 3), cache.levels("points", p, 4, 3)
    return two.groupBy("lod").agg(F.count(F.lit(1)).alias("n")).withColumn("same", F.lit(one is two))


# --- neighbours of nodes


@query(P + ", n AS (SELECT DISTINCT x >> 6 AS nx, y >> 6 AS ny, z >> 6 AS nz FROM pts), " + _LOOK.replace("l AS", "lk AS") + ", o AS (SELECT *, row_number() OVER (ORDER BY i, j, k) - 1 AS bit FROM lk) SELECT a.nx, a.ny, a.nz, CAST(sum(1 << CAST(bit AS INT)) AS INT) AS found FROM n a, o JOIN n b ON b.nx = a.nx + i AND b.ny = a.ny + j AND b.nz = a.nz + k GROUP BY 1, 2, 3")
def jn14_parent_neighbours(s, d):
    return joins.near_nodes(points(s, d, "x", "y", "z"), 6, _STEPS)


@query(P + ", o AS (SELECT x >> 6 AS nx, y >> 6 AS ny, z >> 6 AS nz, bit_or(1 << (4*((x >> 5) & 1) + 2*((y >> 5) & 1) + ((z >> 5) & 1))) AS occ FROM pts GROUP BY 1, 2, 3), s AS (SELECT * FROM (VALUES (1,0,0,1,15),(-1,0,0,2,240),(0,1,0,4,51),(0,-1,0,8,204),(0,0,1,16,85),(0,0,-1,32,170)) AS t(dx, dy, dz, bit, face)) SELECT a.nx, a.ny, a.nz, CAST(coalesce(sum(CASE WHEN b.nx IS NOT NULL THEN bit END), 0) AS INT) AS nodes, CAST(coalesce(sum(CASE WHEN b.occ & face > 0 THEN bit END), 0) AS INT) AS touching FROM o a CROSS JOIN s LEFT JOIN o b ON b.nx = a.nx + dx AND b.ny = a.ny + dy AND b.nz = a.nz + dz GROUP BY 1, 2, 3")
def jn15_child_adjacency(s, d):
    return joins.touching_children(reduce.occupancy(points(s, d, "x", "y", "z"), [5]))


# --- sequences


@query("""WITH s AS (SELECT * FROM (VALUES (0, 4, 0, 8), (1, 2, 0, 4), (2, 1, 0, 2), (3, 3, 2, 4), (4, 6, 4, 8), (5, 5, 4, 6), (6, 7, 6, 8)) AS t(code_order, frame, ref0, ref1)),
r AS (SELECT frame, max(code_order) AS last FROM (SELECT ref0 AS frame, code_order FROM s UNION ALL SELECT ref1, code_order FROM s) GROUP BY 1),
e AS (SELECT coalesce(s.frame, r.frame) AS frame, coalesce(code_order, -1) AS decoded, coalesce(last, -1) AS last FROM s FULL JOIN r ON r.frame = s.frame),
o AS (SELECT *, max(decoded) OVER (ORDER BY frame) AS output FROM e)
SELECT frame, CAST(decoded AS BIGINT) AS decoded, CAST(output AS BIGINT) AS output, CAST(greatest(output, last) AS BIGINT) AS evicted FROM o""")
def str06_reorder_buffer(s, d):
    table = s.createDataFrame([r[:4] for r in schedules.hierarchical(0, 8, 1)], "code_order long, frame int, ref0 int, ref1 int")
    return schedules.output_times(table)


@query(FR + "SELECT frame, CAST(round(x*0.25) AS INT) AS x, CAST(round(y*0.25) AS INT) AS y, CAST(round(z*0.25) AS INT) AS z, count(*) AS n_src FROM frames GROUP BY 1, 2, 3, 4")
def str01_frame_loop(s, d):
    """A stream of frames, each coded on its own: quantised and de-duplicated as it comes."""
    path = scratch(s, "sequence")
    stream.store_sequence(frames(s, d), path)
    coded = lambda b: b.groupBy("frame", *(E.quantise(a, 0.25).alias(a) for a in AXES)).agg(F.count(F.lit(1)).alias("n_src"))
    return stream.run_with_sinks(stream.read_sequence(s, path), "coded", {"coded": coded})["coded"]


@query(FR + "SELECT 'cloud' AS sink, slice, count(*) AS n, CAST(sum(refl) AS BIGINT) AS total FROM frames GROUP BY 2 UNION ALL SELECT 'recoloured', slice, count(*), CAST(sum((refl * 3 + 1) // 2) AS BIGINT) FROM frames GROUP BY 2")
def str10_sinks(s, d):
    path = scratch(s, "sequence")
    stream.store_sequence(frames(s, d), path)
    hooks = {"cloud": lambda b: b.select("slice", "refl"), "recoloured": lambda b: b.select("slice", E.idiv(F.col("refl") * 3 + 1, 2).alias("refl"))}
    sinks = stream.run_with_sinks(stream.read_sequence(s, path), "sinks", hooks)
    rows = [df.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum("refl").cast("long").alias("total")).withColumn("sink", F.lit(k)) for k, df in sinks.items()]
    return rows[0].unionByName(rows[1])


@query(FR + "SELECT frame // 4 AS out_frame, frame % 4 AS frameindex, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM frames GROUP BY 1, 2")
def set03_split_files(s, d):
    """A merged sequence split on frameindex into files of a folder each, read back by folder."""
    merged = frames(s, d).select(E.idiv(F.col("frame"), 4).alias("out_frame"), F.pmod("frame", F.lit(4)).alias("frameindex"), "x")
    path = scratch(s, "split")
    merged.write.partitionBy("out_frame", "frameindex").parquet(path)
    back = s.read.schema("x int, out_frame long, frameindex int").parquet(path)
    return back.groupBy("out_frame", "frameindex").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


# --- formats and options


@query(FR + "SELECT idx, CAST(x AS VARCHAR) AS a, CAST(y AS VARCHAR) AS b, slice AS c, 3 AS n FROM frames")
def src02_words_of_lines(s, d):
    f = frames(s, d).select("idx", F.format_string("  %d\t%d \r %s \r", "x", "y", "slice").alias("line"))
    w = records.words(F.col("line"))
    return f.select("idx", w[0].alias("a"), w[1].alias("b"), w[2].alias("c"), F.size(w).alias("n"))


SQL_GIVEN = "v AS (SELECT frame, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx FROM frames GROUP BY 1), g AS (SELECT row_number() OVER (ORDER BY frame) - 1 AS frame, n, sx FROM v)"


@query(FR + f", {SQL_GIVEN} SELECT frame, CAST(65536 - 2*(n % 50) AS INT) AS m00, CAST(n % 7 AS INT) AS m01, CAST(-(n % 5) AS INT) AS m02, CAST(-(n % 7) AS INT) AS m10, CAST(65536 - (n % 50) AS INT) AS m11, CAST(3*(n % 11) AS INT) AS m12, CAST(n % 5 AS INT) AS m20, 0 AS m21, 65536 AS m22, CAST(sx % 300 AS INT) AS t0, CAST(-(n % 90) AS INT) AS t1, 4 AS t2, 150 AS z_top, 20 AS z_bottom FROM g")
def src07_motion_file(s, d):
    return _motion_of(s, d)


def _motion_of(s, d):
    """Motion rows made from the frames, written as a text file and read again."""
    v = frames(s, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"))
    g = v.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("frame")) - 1).alias("frame"), "n", "sx")  # a row a frame
    n = F.col("n")
    m = [65536 - 2 * (n % 50), n % 7, -(n % 5), -(n % 7), 65536 - n % 50, 3 * (n % 11), n % 5, F.lit(0), F.lit(65536)]
    numbers = [F.format_string("%.10f", e / F.lit(65536.0)) for e in m] + [e.cast("string") for e in (F.col("sx") % 300, -(n % 90), F.lit(4), F.lit(150), F.lit(20))]
    path = scratch(s, "motion")
    g.select("frame", F.concat_ws(" ", *numbers).alias("value")).repartition(1).sortWithinPartitions("frame").select("value").write.text(path)
    return records.read_motion(s, f"{path}/part-*")


@query(FR + f", {SQL_GIVEN} SELECT frame, CAST(sx % 300 AS INT) / 100000.0 < 0.001 AND (n % 90) / 100000.0 < 0.001 AND 4 / 100000.0 < 0.001 AND (3*(n % 11)) / 65536.0 < {3.141592653589793 * 0.05 / 180 * 1.0000002538} AND (n % 5) / 65536.0 < {0.0008726645152351495} AND (n % 7) / (65536.0 - 2*(n % 50)) < 0.0008726648474176 AS eligible FROM g")
def flt10_pair_eligibility(s, d):
    return filters.pair_eligible(_motion_of(s, d), (100000.0, 100000.0, 100000.0)).select("frame", "eligible")


LAYERS = [(r, i, n, v) for r, rows in enumerate([[("octree_bits", "7"), ("octree_bits", "5")], [("neighbours", "3"), ("neighbours", "4")], [("slice_max_points", "100"), ("slice_min_points", "200")], [("partition", "cubes")], [("lod_period", "4"), ("axis_order", "7"), ("lod_period", "0")], [("angular", "true"), ("lasers", "0")], [("bidirectional", "true"), ("group_of_frames", "8"), ("qp", "60"), ("qp", "34")], [("block_size", "64"), ("block_window", "128")]]) for i, (n, v) in enumerate(rows)]
SQL_LAYERS = "l AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {i}, '{n}', '{v}')" for r, i, n, v in LAYERS) + ") AS t(run, layer, name, value))"


@query(f"WITH {SQL_LAYERS} SELECT run, name, arg_max(value, layer) AS value FROM l GROUP BY 1, 2")
def src09_resolved_options(s, d):
    return plan_options.resolved(s.createDataFrame(LAYERS, "run int, layer int, name string, value string"))


@query("SELECT * FROM (VALUES (0, NULL), (1, 'neighbours'), (2, 'slice_min_points'), (3, 'partition'), (4, 'periods'), (5, 'angular'), (6, NULL), (7, 'block_window')) AS t(run, fault)")
def src10_checked_options(s, d):
    return plan_options.checked(src09_resolved_options(s, d))


@query(FR + "SELECT slice AS sequence, CAST(count(*) AS VARCHAR) AS column_1, CAST(CAST(sum(refl) AS BIGINT) AS VARCHAR) AS bits FROM frames GROUP BY 1")
def src11_results_table(s, d):
    path = scratch(s, "results")
    rows = frames(s, d).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum("refl").alias("bits"))
    lines = rows.select(F.lit(1).alias("o"), F.format_string("%s,%d,%d", "slice", "n", "bits").alias("value"))
    head = s.createDataFrame([(0, "# results of a run"), (0, "#more"), (0, "sequence,,bits")], "o int, value string").coalesce(1)
    head.unionByName(lines).repartition(1).sortWithinPartitions("o").select("value").write.text(path)
    return records.read_results(s, path)
