"""Aggregate, window, sort, set and partition queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators import kernels, partition, reduce
from cloudloom.queries.projections import sql_morton
from cloudloom.queries.registry import query
from cloudloom.sources.clouds import SQL_FRAMES, SQL_INDEXED, SQL_POINTS, SQL_SMALL, frames, indexed_points, points, small_points

P, I, FR, S3 = f"WITH {SQL_POINTS} ", f"WITH {SQL_INDEXED} ", f"WITH {SQL_FRAMES} ", f"WITH {SQL_SMALL} "
BOX = "min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z"


@query(P + ", q AS (SELECT CAST(round(x*0.25) AS INT) AS x, CAST(round(y*0.25) AS INT) AS y, CAST(round(z*0.25) AS INT) AS z, count(*) AS n_src FROM pts GROUP BY 1, 2, 3) SELECT CAST(x // 64 AS BIGINT) AS tx, CAST(y // 64 AS BIGINT) AS ty, CAST(z // 64 AS BIGINT) AS tz, count(*) AS n_pts, CAST(sum(n_src) AS BIGINT) AS n_src, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x)-min(x)+1 AS size_x, max(y)-min(y)+1 AS size_y, max(z)-min(z)+1 AS size_z FROM q GROUP BY 1, 2, 3")
def flagship_tile_inventory(s, d):
    return partition.tile_inventory(reduce.quantise_dedup(points(s, d, "x", "y", "z"), 0.25), 64)


@query(P + f"SELECT {BOX} FROM pts")
def agg01_bounding_box(s, d):
    return reduce.bounding_box(points(s, d, "x", "y", "z"))


@query(P + f"SELECT CAST(x // 256 AS BIGINT) AS tile, {BOX} FROM pts GROUP BY 1")
def agg02_tile_boxes(s, d):
    return reduce.bounding_box(points(s, d, "x", "y", "z").withColumn("tile", E.idiv(F.col("x"), 256)), "tile")


@query(P + ", b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts) SELECT lx - lx % 3 AS ox, ly - ly % 3 AS oy, lz - lz % 3 AS oz, hx - (lx - lx % 3) + 1 AS sx, hy - (ly - ly % 3) + 1 AS sy, hz - (lz - lz % 3) + 1 AS sz FROM b")
def agg03_sequence_box(s, d):
    box = reduce.bounding_box(points(s, d, "x", "y", "z"))
    origin = {a: F.col(f"min_{a}") - F.pmod(F.col(f"min_{a}"), F.lit(3)) for a in "xyz"}
    return box.select(*(o.alias(f"o{a}") for a, o in origin.items()), *((F.col(f"max_{a}") - o + 1).alias(f"s{a}") for a, o in origin.items()))


@query(P + "SELECT CAST(x // 128 AS BIGINT) AS tx, CAST(y // 128 AS BIGINT) AS ty, CAST(z // 128 AS BIGINT) AS tz, count(*) AS n_pts, CAST(count(*) AS BIGINT) AS n_src, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x)-min(x)+1 AS size_x, max(y)-min(y)+1 AS size_y, max(z)-min(z)+1 AS size_z FROM pts GROUP BY 1, 2, 3")
def agg04_tile_inventory(s, d):
    return partition.tile_inventory(points(s, d, "x", "y", "z").withColumn("n_src", F.lit(1).cast("bigint")), 128)


@query(I + "SELECT CAST(round(x*0.125) AS INT) AS x, CAST(round(y*0.125) AS INT) AS y, CAST(round(z*0.125) AS INT) AS z, min(idx) AS idx, arg_min(refl, idx) AS refl, count(*) AS n_src FROM pts GROUP BY 1, 2, 3")
def agg05_dedup_first_wins(s, d):
    return reduce.reduce_points(indexed_points(s, d, "x", "y", "z", "refl"), {a: E.quantise(a, 0.125) for a in "xyz"}, {"refl": F.col("refl")})


@query(P + "SELECT CAST(round(x*0.5) AS INT) AS x, CAST(round(y*0.5) AS INT) AS y, CAST(round(z*0.5) AS INT) AS z, count(*) AS n_src FROM pts GROUP BY 1, 2, 3")
def agg06_quantise_dedup(s, d):
    return reduce.quantise_dedup(points(s, d, "x", "y", "z"), 0.5)


@query(I + "SELECT CAST(round(x*0.0625) AS INT) AS kx, CAST(round(y*0.0625) AS INT) AS ky, CAST(round(z*0.0625) AS INT) AS kz, min(idx) AS idx, arg_min(CAST(round(x*0.5) AS INT), idx) AS x, arg_min(CAST(round(y*0.5) AS INT), idx) AS y, arg_min(CAST(round(z*0.5) AS INT), idx) AS z, count(*) AS n_src FROM pts GROUP BY 1, 2, 3")
def agg07_subsample_two_scales(s, d):
    return reduce.reduce_points(indexed_points(s, d, "x", "y", "z"), {f"k{a}": E.quantise(a, 0.0625) for a in "xyz"}, {a: E.quantise(a, 0.5) for a in "xyz"})


@query(I + ", m AS (SELECT idx, laser, x & ~63 AS mx, lag(x & ~63) OVER (PARTITION BY laser ORDER BY idx) AS prev FROM pts) SELECT idx, laser, mx FROM m WHERE prev IS NULL OR prev <> mx")
def agg08_adjacent_unique(s, d):
    p = indexed_points(s, d, "x", "laser").select("idx", "laser", F.col("x").bitwiseAND(~63).alias("mx"))
    return partition.adjacent_unique(p, "mx", "idx", "laser")


@query(P + "SELECT level, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS points FROM (SELECT level, x >> CAST(level AS INT) AS a, y >> CAST(level AS INT) AS b, z >> CAST(level AS INT) AS c, count(*) AS n FROM pts, (SELECT CAST(unnest(range(0, 8)) AS INT) AS level) GROUP BY 1, 2, 3, 4) GROUP BY 1")
def agg09_level_counts(s, d):
    return reduce.level_counts(points(s, d, "x", "y", "z"), 8)


SQL_OCC = "SELECT level, x >> (level+1) AS nx, y >> (level+1) AS ny, z >> (level+1) AS nz, bit_or(1 << (4*((x >> level) & 1) + 2*((y >> level) & 1) + ((z >> level) & 1))) AS occupancy FROM {t}, (SELECT CAST(unnest([2, 4, 6]) AS INT) AS level) GROUP BY 1, 2, 3, 4"


@query(P + SQL_OCC.format(t="pts"))
def agg10_octree_occupancy(s, d):
    return reduce.occupancy(points(s, d, "x", "y", "z"), [2, 4, 6])


@query(P + "SELECT x >> 5 AS nx, y >> 5 AS ny, z >> 5 AS nz, 4*((x >> 4) & 1) + 2*((y >> 4) & 1) + ((z >> 4) & 1) AS child, count(*) AS n FROM pts GROUP BY 1, 2, 3, 4")
def agg11_child_counts(s, d):
    child = F.expr("4 * (shiftright(x, 4) & 1) + 2 * (shiftright(y, 4) & 1) + (shiftright(z, 4) & 1)")
    return points(s, d, "x", "y", "z").groupBy(*(F.shiftright(F.col(a), 5).alias(f"n{a}") for a in "xyz"), child.alias("child")).agg(F.count(F.lit(1)).alias("n"))


SQL_OCC_BY_FRAME = "SELECT frame, level, x >> (level+1) AS nx, y >> (level+1) AS ny, z >> (level+1) AS nz, bit_or(1 << (4*((x >> level) & 1) + 2*((y >> level) & 1) + ((z >> level) & 1))) AS occupancy FROM frames, (SELECT CAST(unnest([2, 4, 6]) AS INT) AS level) GROUP BY 1, 2, 3, 4, 5"


@query(FR + f", o AS ({SQL_OCC_BY_FRAME}), b AS (SELECT frame + 1 AS frame, level, nx, ny, nz, occupancy FROM o) SELECT frame, level, count(*) AS nodes, CAST(sum(bit_count(xor(coalesce(o.occupancy, 0), coalesce(b.occupancy, 0)))) AS BIGINT) AS missed FROM o FULL JOIN b USING (frame, level, nx, ny, nz) GROUP BY 1, 2")
def agg12_occupancy_mispredicts(s, d):
    return reduce.mispredicts(frames(s, d), [2, 4, 6])


@query(P + ", n AS (SELECT count(*) AS n FROM pts GROUP BY x >> 6, y >> 6, z >> 6), c AS (SELECT n, sum(n) OVER (ORDER BY n RANGE UNBOUNDED PRECEDING) / sum(n) OVER () AS share FROM n) SELECT min(CASE WHEN share > 0.05 THEN n END) AS th1, min(CASE WHEN share > 0.6 THEN n END) AS th2 FROM c")
def agg13_density_thresholds(s, d):
    nodes = points(s, d, "x", "y", "z").groupBy(*(F.shiftright(F.col(a), 6) for a in "xyz")).agg(F.count(F.lit(1)).alias("n"))
    return reduce.density_thresholds(nodes)


@query(P + ", h AS (SELECT CAST(z // 25 AS BIGINT) AS bin, count(*) AS n FROM pts GROUP BY 1), m AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(bin*n) AS DOUBLE)/CAST(sum(n) AS DOUBLE) AS mean, CAST(sum(bin*bin*n) AS DOUBLE)/CAST(sum(n) AS DOUBLE) AS q, arg_max(bin, row(n, -bin)) AS mode FROM h) SELECT n, round(mean, 6) AS mean, round(q - mean*mean, 4) AS variance, mode, round(mean - 1.5::DOUBLE*sqrt(q - mean*mean), 4) AS low, round(mean + 1.5::DOUBLE*sqrt(q - mean*mean), 4) AS high FROM m")
def agg14_z_histogram(s, d):
    m = reduce.histogram_moments(reduce.histogram(points(s, d, "z"), "z", 25), 1.5)
    return m.select("n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "mode", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(I + ", s AS (SELECT * FROM pts WHERE idx % 200 = 0), d AS (SELECT s.idx, min(CAST(s.x-p.x AS BIGINT)*(s.x-p.x) + CAST(s.y-p.y AS BIGINT)*(s.y-p.y) + CAST(s.z-p.z AS BIGINT)*(s.z-p.z)) AS d2 FROM s JOIN pts p ON p.idx BETWEEN s.idx - 32 AND s.idx + 32 AND p.idx <> s.idx GROUP BY 1) SELECT d2 AS dist2 FROM (SELECT d2, row_number() OVER (ORDER BY d2) - 1 AS r, count(*) OVER () AS c FROM d) WHERE r = floor(c * 0.5)")
def agg15_nearest_distance_percentile(s, d):
    return partition.sampled_distance(indexed_points(s, d, "x", "y", "z"), 200, 32, 0.5)


@query(P + ", q AS (SELECT laser, c0, c1, c2, 128 + ((c0-128) // 8)*8 AS r0, 128 + ((c1-128) // 8)*8 AS r1, 128 + ((c2-128) // 8)*8 AS r2 FROM pts) SELECT laser, CAST(sum(abs(c0 - least(greatest(r0,0),255)) + abs(c1 - least(greatest(r1,0),255)) + abs(c2 - least(greatest(r2,0),255))) AS BIGINT) AS error FROM q GROUP BY 1")
def agg17_reconstruction_error(s, d):
    rebuilt = lambda c: E.clip(128 + E.idiv(F.col(c) - 128, 8) * 8, 0, 255)
    gaps = [F.abs(F.col(c) - rebuilt(c)) for c in ("c0", "c1", "c2")]
    return points(s, d, "laser", "c0", "c1", "c2").groupBy("laser").agg(F.sum(gaps[0] + gaps[1] + gaps[2]).alias("error"))


SQL_RES = "r AS (SELECT laser AS lod, c0-128 AS r0, c1-40 AS r1, c2-128 AS r2 FROM pts)"


@query(P + f", {SQL_RES}, e AS (SELECT lod, w, CAST(sum(abs(r2 - ((w*r0 + 2) >> 2))) AS BIGINT) AS err, CAST(sum(abs(r2)) AS BIGINT) AS base FROM r, (SELECT CAST(unnest(range(1, 9)) AS INT) AS w) GROUP BY 1, 2) SELECT lod, CASE WHEN min(err) < any_value(base) THEN arg_min(w, row(err, w)) ELSE 0 END AS w FROM e GROUP BY 1")
def agg18_inter_component_weights(s, d):
    r = points(s, d, "laser", "c0", "c2").select(F.col("laser").alias("lod"), (F.col("c0") - 128).alias("r0"), (F.col("c2") - 128).alias("r2"))
    return reduce.component_weights(r, "lod", "r0", "r2")


@query(P + f", {SQL_RES}, s AS (SELECT lod, CAST(sum(r1*r2) AS BIGINT) AS xy, CAST(sum(r1*r1) AS BIGINT) AS xx FROM r GROUP BY 1) SELECT lod, CASE WHEN xx = 0 THEN 0 ELSE least(greatest((4*xy + CASE WHEN xy < 0 THEN -1 ELSE 1 END * (xx // 2)) // xx, -8), 8) END AS w FROM s")
def agg19_last_component_weights(s, d):
    r = points(s, d, "laser", "c1", "c2").select(F.col("laser").alias("lod"), (F.col("c1") - 40).alias("r1"), (F.col("c2") - 128).alias("r2"))
    return reduce.last_component_weights(r, "lod", "r1", "r2")


SQL_MOTION = "m AS (SELECT t.frame, s.x AS ax, s.y AS ay, s.z AS az, t.x AS bx, t.y AS by_, t.z AS bz FROM (SELECT t.idx AS t, arg_min(s.idx, row({d}, s.idx)) AS s FROM frames t JOIN frames s ON s.frame = t.frame - 1 GROUP BY 1) e JOIN frames t ON t.idx = e.t JOIN frames s ON s.idx = e.s)".format(d=" + ".join(f"CAST(t.{x}-s.{x} AS BIGINT)*(t.{x}-s.{x})" for x in "xyz"))


def sql_motion_sums() -> str:
    return ", ".join(f"CAST(sum(CAST({p.replace('by', 'by_')} AS BIGINT) * {q}) AS BIGINT) AS {name}" for name, (p, q) in kernels.MOTION_SUMS.items())


@query(FR + f", {SQL_MOTION} SELECT frame, {sql_motion_sums()} FROM m GROUP BY 1")
def agg20_normal_equations(s, d):
    f = frames(s, d)
    return kernels.motion_sums(f.withColumn("frame", F.col("frame") + 1), f)


SQL_METRIC = "m AS (SELECT slice AS sequence, CAST(refl*8 + 8 AS BIGINT) AS bits, CAST(x + 1 AS BIGINT) AS points, z AS peak, CASE WHEN refl % 10 = 0 THEN 'mismatch' ELSE 'ok' END AS status, CAST(refl + 1 AS DOUBLE) / 10 AS seconds, CAST(y AS DOUBLE) / 1000 AS psnr FROM frames)"


def _metrics(s, d):
    return frames(s, d).select(F.col("slice").alias("sequence"), (F.col("refl") * 8 + 8).cast("bigint").alias("bits"), (F.col("x") + 1).cast("bigint").alias("points"), F.col("z").alias("peak"), F.when(F.col("refl") % 10 == 0, "mismatch").otherwise("ok").alias("status"), ((F.col("refl") + 1) / F.lit(10.0)).alias("seconds"), (F.col("y") / F.lit(1000.0)).alias("psnr"))


@query(FR + f", {SQL_METRIC} SELECT sequence, count(*) AS frames, CAST(sum(bits) AS BIGINT) AS bits, CAST(sum(points) AS BIGINT) AS points, max(peak) AS peak, array_to_string(list_sort(list(DISTINCT status)), ',') AS status, round(exp(avg(ln(seconds))), 6) AS geo_seconds, round(avg(psnr), 6) AS psnr FROM m GROUP BY 1")
def agg22_collate_metrics(s, d):
    m = reduce.collate(_metrics(s, d), "sequence")
    return m.withColumns({"geo_seconds": F.round("geo_seconds", 6), "psnr": F.round("psnr", 6)})


@query(FR + f", {SQL_METRIC} SELECT sequence, round(CAST(sum(bits) AS DOUBLE) / CAST(sum(points) AS DOUBLE), 6) AS bpp, bool_and(status = 'ok') AS all_ok FROM m GROUP BY 1")
def agg23_summarise_metrics(s, d):
    m = reduce.collate(_metrics(s, d), "sequence")
    return m.select("sequence", F.round(F.col("bits") / F.col("points"), 6).alias("bpp"), (F.col("status") == "ok").alias("all_ok"))



@query(FR + ", g AS (SELECT frame, x, slice, CAST(sum(refl) AS BIGINT) AS v FROM frames GROUP BY 1, 2, 3), s AS (SELECT a.frame, a.slice, CAST(sum(a.v*b.v) AS BIGINT) AS cross_, CAST(sum(b.v*b.v) AS BIGINT) AS auto_ FROM g a JOIN g b ON b.frame = a.frame - 1 AND a.x = b.x AND a.slice = b.slice GROUP BY 1, 2) SELECT frame, slice, cross_, auto_, CAST(floor(cross_ * 128.0::DOUBLE / auto_) AS BIGINT) AS tap FROM s WHERE auto_ > 0")
def agg25_filter_tap(s, d):
    # values of one node are summed first, so that a node meets one partner
    g = frames(s, d).groupBy("frame", "x", "slice").agg(F.sum("refl").alias("a"))
    both = g.join(g.select((F.col("frame") + 1).alias("frame"), "x", "slice", F.col("a").alias("b")), ["frame", "x", "slice"])
    sums = both.groupBy("frame", "slice").agg(F.sum(F.col("a") * F.col("b")).alias("cross_"), F.sum(F.col("b") * F.col("b")).alias("auto_"))
    return sums.filter("auto_ > 0").withColumn("tap", F.floor(F.col("cross_") * 128.0 / F.col("auto_")))


@query(FR + "SELECT frame, round(8.0::DOUBLE * CAST(sum(refl) AS DOUBLE) / count(*), 6) AS bpp FROM frames GROUP BY 1")
def agg26_bits_per_point(s, d):
    return frames(s, d).groupBy("frame").agg(F.round(F.lit(8.0) * F.sum("refl") / F.count(F.lit(1)), 6).alias("bpp"))


@query(I + "SELECT idx, x, y, z FROM pts WHERE laser = 3 ORDER BY x, idx LIMIT 1")
def agg27_origin_first_least(s, d):
    best = F.min_by(F.struct("idx", "x", "y", "z"), F.struct("x", "idx"))
    return indexed_points(s, d, "x", "y", "z", "laser").filter("laser = 3").agg(best.alias("b")).select("b.*")


@query(P + ", c AS (SELECT refl, count(*) AS n FROM pts GROUP BY 1) SELECT round(-sum(n/t*log2(n/t)), 6) AS entropy FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS t FROM c)")
def agg28_empirical_entropy(s, d):
    c = points(s, d, "refl").groupBy("refl").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return c.crossJoin(F.broadcast(total)).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"))  # one row


TILE_MORTON = sql_morton("x // 256", "y // 256", "z // 256")


@query(P + f", t AS (SELECT DISTINCT {TILE_MORTON} AS m FROM pts), r AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS tile_id FROM t) SELECT tile_id, count(*) AS n FROM (SELECT {TILE_MORTON} AS m FROM pts) JOIN r USING (m) GROUP BY 1")
def win01_prt01_morton_tiles(s, d):
    return partition.tile_counts(points(s, d, "x", "y", "z"), 256)


@query(P + ", k AS (SELECT x >> 7 AS a, y >> 7 AS b, z >> 7 AS c FROM pts), r AS (SELECT a, b, c, row_number() OVER (ORDER BY a, b, c) - 1 AS slice_id FROM (SELECT DISTINCT * FROM k)) SELECT slice_id, count(*) AS n FROM k JOIN r USING (a, b, c) GROUP BY 1")
def win02_prt05_octree_slices(s, d):
    return partition.octree_slices(points(s, d, "x", "y", "z"), 7).groupBy("slice_id").agg(F.count(F.lit(1)).alias("n"))


@query(I + "SELECT CAST(idx // 5000 AS BIGINT) AS slice_id, count(*) AS n, min(idx) AS first_idx, CAST(sum(refl) AS BIGINT) AS refl FROM pts GROUP BY 1")
def win03_prt06_n_point_slices(s, d):
    p = indexed_points(s, d, "refl").withColumn("slice_id", E.idiv(F.col("idx"), 5000))
    return p.groupBy("slice_id").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.sum("refl").alias("refl"))


@query(I + "SELECT idx, x, y, z FROM pts WHERE idx % 16 = 0")
def win04_lod04_decimation(s, d):
    return indexed_points(s, d, "x", "y", "z").filter("idx % 16 = 0")


@query(I + ", m AS (SELECT idx, laser, x >> 7 AS v, lag(x >> 7) OVER (PARTITION BY laser ORDER BY idx) AS p FROM pts), g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> v THEN 1 ELSE 0 END) OVER (PARTITION BY laser ORDER BY idx) AS run FROM m) SELECT laser, min(idx) AS idx, any_value(v) AS v, count(*) - 1 AS dups FROM g GROUP BY laser, run")
def win05_duplicate_runs(s, d):
    p = indexed_points(s, d, "x", "laser").select("idx", "laser", F.shiftright("x", 7).alias("v"))
    return partition.runs(p, "v", "idx", "laser").select("laser", "idx", "v", (F.col("n") - 1).alias("dups"))


@query(I + "SELECT idx, laser, lag(idx) OVER (PARTITION BY laser, z > 1200 ORDER BY idx) AS parent FROM pts")
def win06_predecessor_per_laser(s, d):
    p = indexed_points(s, d, "z", "laser").select("idx", "laser", (F.col("z") > 1200).alias("object"))
    return partition.before_in_chunks(p, ["laser", "object"], "idx", []).select("idx", "laser", F.get("before", F.lit(0))["idx"].alias("parent"))


@query(I + ", f AS (SELECT laser, min(idx) AS idx FROM pts GROUP BY 1) SELECT laser, idx, lag(idx) OVER (ORDER BY laser) AS parent FROM f")
def win07_first_of_laser_chain(s, d):
    firsts = indexed_points(s, d, "laser").groupBy("laser").agg(F.min("idx").alias("idx"))
    return firsts.withColumn("parent", F.lag("idx").over(Window.partitionBy(F.lit(0)).orderBy("laser")))  # a row for each laser


@query(I + ", l AS (SELECT idx, laser, x, lag(x) OVER w AS p0, lag(x, 2) OVER w AS p1, lag(x, 3) OVER w AS p2 FROM pts WINDOW w AS (PARTITION BY laser ORDER BY idx)) SELECT idx, x - p0 AS delta, x - (2*p0 - p1) AS linear, x - (p0 + p1 - p2) AS third FROM l")
def win08_linear_predictors(s, d):
    p = partition.before_in_chunks(indexed_points(s, d, "x", "laser"), ["laser"], "idx", ["x"], 3).select("idx", "x", *(F.get("before", F.lit(i))["x"].alias(f"p{i}") for i in range(3)))
    x, a, b, c = (F.col(n) for n in ("x", "p0", "p1", "p2"))
    return p.select("idx", (x - a).alias("delta"), (x - (2 * a - b)).alias("linear"), (x - (a + b - c)).alias("third"))


@query(I + ", m AS (SELECT idx, laser, refl >= 60 AS nz, lag(refl >= 60) OVER (PARTITION BY laser ORDER BY idx) AS p FROM pts), g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> nz THEN 1 ELSE 0 END) OVER (PARTITION BY laser ORDER BY idx) AS run FROM m) SELECT laser, min(idx) AS idx, count(*) AS n FROM g WHERE NOT nz GROUP BY laser, run")
def win10_zero_runs(s, d):
    p = indexed_points(s, d, "refl", "laser").select("idx", "laser", (F.col("refl") >= 60).alias("v"))
    return partition.runs(p, "v", "idx", "laser").filter("not v").select("laser", "idx", "n")


@query(FR + ", m AS (SELECT frame, round(avg(x), 6) AS mx FROM frames GROUP BY 1) SELECT frame, mx, mx > lag(mx) OVER (ORDER BY frame) AS moving FROM m")
def win11_moving_status(s, d):
    m = frames(s, d).groupBy("frame").agg(F.round(F.avg("x"), 6).alias("mx"))
    return m.withColumn("moving", F.col("mx") > F.lag("mx").over(Window.partitionBy(F.lit(0)).orderBy("frame")))  # a row a frame


SQL_CTR = "c AS (SELECT frame AS seq, (frame * 3) % 16 AS lsb FROM (SELECT DISTINCT frame FROM frames))"


@query(FR + f", {SQL_CTR}, g AS (SELECT seq, lsb, lsb - lag(lsb) OVER (ORDER BY seq) AS gap FROM c) SELECT seq, lsb, CAST(first_value(lsb) OVER w + sum(coalesce(CASE WHEN gap <= -8 THEN gap + 16 WHEN gap > 8 THEN gap - 16 ELSE gap END, 0)) OVER w AS BIGINT) AS counter FROM g WINDOW w AS (ORDER BY seq)")
def win12_str02_counter_unwrap(s, d):
    c = frames(s, d).select(F.col("frame").alias("seq")).distinct().withColumn("lsb", F.col("seq") * 3 % 16)
    return partition.unwrap_counter(c, "seq", "lsb", 16)


@query(I + f"SELECT idx, row_number() OVER (ORDER BY {sql_morton('x', 'y', 'z')}, idx) - 1 AS place FROM pts")
def srt01_morton_order(s, d):
    return partition.sorted_place(indexed_points(s, d, "x", "y", "z").withColumn("k", E.morton("x", "y", "z")), ["k", "idx"]).select("idx", "place")


@query(I + f"SELECT idx, idx // 4096 AS chunk, row_number() OVER (PARTITION BY idx // 4096 ORDER BY {sql_morton('x', 'y', 'z')}, idx) - 1 AS place FROM pts")
def srt02_chunked_morton_order(s, d):
    p = indexed_points(s, d, "x", "y", "z").withColumn("chunk", E.idiv(F.col("idx"), 4096))
    return p.select("idx", "chunk", (F.row_number().over(Window.partitionBy("chunk").orderBy(E.morton("x", "y", "z"), "idx")) - 1).alias("place"))


@query(I + "SELECT idx, x, y, z FROM pts")
def srt03_canonical_order(s, d):
    return indexed_points(s, d, "x", "y", "z").sort("idx")


@query(I + "SELECT idx, laser, row_number() OVER (PARTITION BY laser ORDER BY round(atan2(CAST(y-900 AS DOUBLE), CAST(x-500 AS DOUBLE))*1000), (x-500)*(x-500)+(y-900)*(y-900), idx) - 1 AS place FROM pts")
def srt05_azimuth_order(s, d):
    # keys of larger tables give squares beyond 32 bits
    p, x, y = indexed_points(s, d, "x", "y", "laser"), F.col("x").cast("bigint") - 500, F.col("y").cast("bigint") - 900
    keyed = p.select("idx", "laser", F.round(F.atan2(y.cast("double"), x.cast("double")) * 1000).alias("phi"), (x * x + y * y).alias("r2"))
    return partition.place_within(keyed, ["laser"], ["phi", "r2", "idx"]).select("idx", "laser", "place")


@query(I + "SELECT idx, laser, row_number() OVER (PARTITION BY laser ORDER BY CAST(x AS BIGINT)*x+CAST(y AS BIGINT)*y, idx) - 1 AS place FROM pts")
def srt07_radius_order(s, d):
    r2 = F.col("x").cast("bigint") * F.col("x") + F.col("y").cast("bigint") * F.col("y")
    return partition.place_within(indexed_points(s, d, "x", "y", "laser").select("idx", "laser", r2.alias("r2")), ["laser"], ["r2", "idx"]).select("idx", "laser", "place")


_PHI = "round(atan2(CAST(y-900 AS DOUBLE), CAST(x-500 AS DOUBLE))*1000)"
_R = "sqrt(CAST((x-500)*(x-500) + (y-900)*(y-900) AS DOUBLE))"


@query(I + f"SELECT 'angle' AS by_, idx, row_number() OVER (ORDER BY laser, idx) - 1 AS place FROM pts UNION ALL SELECT 'azimuth', idx, row_number() OVER (ORDER BY {_PHI}, {_R}, CASE WHEN {_R} > 0 THEN z / {_R} ELSE 0.0 END, idx) - 1 FROM pts")
def srt08_laser_order(s, d):
    """By laser angle, and by azimuth for a cloud without that column."""
    p = indexed_points(s, d, "x", "y", "z", "laser").withColumnRenamed("laser", "laserangle")
    both = [partition.laser_order(df, (500, 900)).select(F.lit(by).alias("by_"), "idx", "place") for by, df in (("angle", p), ("azimuth", p.drop("laserangle")))]
    return both[0].unionByName(both[1])


@query(P + ", e AS (SELECT max(x)-min(x) AS ex, max(y)-min(y) AS ey, max(z)-min(z) AS ez FROM pts) SELECT CASE WHEN ex >= ey AND ex >= ez THEN 'x' WHEN ey >= ez THEN 'y' ELSE 'z' END AS longest, CASE WHEN ex <= ey AND ex <= ez THEN 'x' WHEN ey <= ez THEN 'y' ELSE 'z' END AS shortest FROM e")
def srt09_prt08_axes_by_extent(s, d):
    return partition.axes_by_extent(points(s, d, "x", "y", "z"))


@query(P + "SELECT laser, refl AS median FROM (SELECT laser, refl, row_number() OVER (PARTITION BY laser ORDER BY refl) - 1 AS r, count(*) OVER (PARTITION BY laser) AS c FROM pts) WHERE r = c // 2")
def top03_order_statistic(s, d):
    return partition.order_statistic(points(s, d, "laser", "refl"), "laser", "refl", 1, 2, "median")


@query(P + ", l AS (SELECT level, count(*) AS nodes FROM (SELECT DISTINCT level, x >> level AS a, y >> level AS b, z >> level AS c FROM pts, (SELECT CAST(unnest(range(0, 12)) AS INT) AS level)) GROUP BY 1) SELECT min(level) AS level FROM l WHERE nodes <= 1000")
def top04_level_for_limit(s, d):
    return reduce.level_counts(points(s, d, "x", "y", "z"), 12).filter("nodes <= 1000").agg(F.min("level").alias("level"))


@query(FR + "SELECT slice, count(*) AS n, count(*) > 2500 AS over_limit FROM frames GROUP BY 1")
def top05_slice_limit(s, d):
    return partition.over_limit(frames(s, d), "slice", 2500)


@query(S3 + ", f AS (SELECT idx, x, y, z, label, NULL::INT AS refl FROM emb3 UNION ALL SELECT idx + 1000000, y, z, x, NULL, 5 FROM emb3) SELECT * FROM f")
def set01_append(s, d):
    p = small_points(s, d)
    q = p.select((F.col("idx") + 1000000).alias("idx"), F.col("y").alias("x"), F.col("z").alias("y"), F.col("x").alias("z"), F.lit(5).alias("refl"))
    return p.unionByName(q, allowMissingColumns=True)


@query(FR + "SELECT idx, CAST(frame // 4 AS BIGINT) AS out_frame, frame % 4 AS frameindex, x, y, z FROM frames")
def set02_merge_frames(s, d):
    return frames(s, d).select("idx", E.idiv(F.col("frame"), 4).alias("out_frame"), (F.col("frame") % 4).alias("frameindex"), "x", "y", "z")



@query(FR + ", o AS (SELECT frame, slice, min(x) AS ox, min(y) AS oy, min(z) AS oz FROM frames GROUP BY 1, 2) SELECT idx, f.frame, x, y, z FROM frames f JOIN o USING (frame, slice)")
def set04_accumulate_slices(s, d):
    f = frames(s, d)
    o = f.groupBy("frame", "slice").agg(*(F.min(a).alias(f"o{a}") for a in "xyz"))
    local = f.join(o, ["frame", "slice"]).select("idx", "frame", *((F.col(a) - F.col(f"o{a}")).alias(a) for a in "xyz"), "ox", "oy", "oz")
    return local.select("idx", "frame", *((F.col(a) + F.col(f"o{a}")).alias(a) for a in "xyz"))


@query(FR + "SELECT idx, frame + 1 AS target, x, y, z FROM frames UNION ALL SELECT idx, frame - 1, x, y, z FROM frames")
def set05_two_references(s, d):
    f = frames(s, d)
    both = [f.select("idx", (F.col("frame") + step).alias("target"), "x", "y", "z") for step in (1, -1)]
    return both[0].unionByName(both[1])


@query(P + "SELECT DISTINCT x >> 5 AS x, y >> 5 AS y, z >> 5 AS z FROM pts")
def set06_unique_positions(s, d):
    return points(s, d, "x", "y", "z").select(*(F.shiftright(F.col(a), 5).alias(a) for a in "xyz")).distinct()


@query(P + "SELECT count(*) AS n, 0 AS slice_id FROM pts")
def prt02_one_slice(s, d):
    return points(s, d, "x").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("slice_id"))


@query(FR + ", n AS (SELECT slice, count(*) AS n FROM frames GROUP BY 1) SELECT slice, n, CASE WHEN n < 2000 THEN 'none' ELSE 'uniform' END AS method FROM n")
def prt10_method_choice(s, d):
    return frames(s, d).groupBy("slice").agg(F.count(F.lit(1)).alias("n")).withColumn("method", F.when(F.col("n") < 2000, "none").otherwise("uniform"))


@query(FR + "SELECT x // 32 AS wx, y // 8192 AS wy, z // 64 AS wz, count(*) AS n FROM frames WHERE x // 32 < 4 AND y // 8192 < 8 AND z // 64 < 6 GROUP BY 1, 2, 3")
def prt11_motion_windows(s, d):
    w = frames(s, d).select(*(E.idiv(F.col(a), n).cast("int").alias(f"w{a}") for a, n in (("x", 32), ("y", 8192), ("z", 64)))).filter("wx < 4 and wy < 8 and wz < 6")
    return w.groupBy("wx", "wy", "wz").agg(F.count(F.lit(1)).alias("n"))


@query(FR + ", e AS (SELECT idx, x + dx AS ex, y + dy AS ey FROM frames, (SELECT unnest([-8, 0, 8]) AS dx), (SELECT unnest([-600, 0, 600]) AS dy) WHERE idx % 4 = 0) SELECT DISTINCT idx, CAST(floor(ex / 64.0) AS BIGINT) AS bx, CAST(floor(ey / 4096.0) AS BIGINT) AS by_ FROM e")
def prt12_blocks_with_halo(s, d):
    return partition.blocks_with_halo(frames(s, d).filter("idx % 4 = 0"), {"x": (64, 8, "bx"), "y": (4096, 600, "by_")})
