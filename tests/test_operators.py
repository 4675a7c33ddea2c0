"""Operators against brute force, and their invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import hierarchy, joins, kernels, lod, partition, prediction, surface, trees
from cloudloom.plans import schedules
from cloudloom.sources import ply, records
from cloudloom.sources.clouds import frames


def cloud(spark, n, seed, span=400):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, span, (n, 3))
    return p, spark.createDataFrame([(i, *map(int, v)) for i, v in enumerate(p)], "idx long, x int, y int, z int")


@pytest.mark.parametrize("cell", [None, 3, 1000])
def test_knn_is_exact_for_any_cell(spark, cell):
    p, a = cloud(spark, 150, 1)
    q, b = cloud(spark, 90, 2)
    got = {(r.t, r.rank): (r.s, r.d2) for r in joins.knn_join(b, a, 4, cell).collect()}
    d = ((q[:, None] - p[None]) ** 2).sum(2)
    for t in range(len(q)):
        order = np.lexsort((np.arange(len(p)), d[t]))[:4]
        assert [got[t, k + 1] for k in range(4)] == [(int(s), int(d[t, s])) for s in order]


def test_knn_with_few_or_no_sources(spark):
    _, a = cloud(spark, 2, 1)
    _, b = cloud(spark, 5, 2, 9000)
    assert joins.knn_join(b, a, 8).count() == 10
    assert joins.knn_join(b, a.limit(0), 8).count() == 0
    assert joins.knn_join(b.limit(0), a, 8).count() == 0


def test_index_does_not_depend_on_partitions(spark, sf_dir):
    from cloudloom.sources.clouds import dense_index

    f = frames(spark, sf_dir).select("idx", "x")
    one = dense_index(f, ["x", "idx"], "place").orderBy("idx").collect()
    two = dense_index(f.repartition(7), ["x", "idx"], "place", ranges=5).orderBy("idx").collect()
    assert one == two and sorted(r.place for r in one) == list(range(len(one)))


def test_distance_sample_keeps_apart_and_covers(spark, sf_dir):
    f = frames(spark, sf_dir).filter("frame = 1")
    kept = {r.idx for r in lod.distance_sample(f, "frame", 3).collect()}
    rows = {r.idx: (r.x, r.y, r.z) for r in f.collect()}
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(rows[a], rows[b], strict=True))
    assert all(d(a, b) > 3 * 64 for a in kept for b in kept if a < b)
    assert all(any(d(a, b) <= 3 * 64 for b in kept) for a in rows)


def test_nearest_tree_is_a_tree(spark, sf_dir):
    rows = kernels.nearest_tree(frames(spark, sf_dir), "frame").collect()
    by = {}
    for r in rows:
        by.setdefault(r.slice, {})[r.idx] = r.parent
    for parents in by.values():
        assert sum(p == -1 for p in parents.values()) == 1
        assert all(p < i for i, p in parents.items())
        counts = {}
        for p in parents.values():
            counts[p] = counts.get(p, 0) + 1
        assert max(v for p, v in counts.items() if p >= 0) <= 3


def test_slices_cover_and_keep_their_limit(spark):
    _, a = cloud(spark, 500, 3)
    s = partition.uniform_slices(a, 60)
    assert s.count() == 500
    parts = partition.split_slices(s, "slice_id", "x", 20).groupBy("slice_id", "part").count().collect()
    assert sum(r["count"] for r in parts) == 500 and max(r["count"] for r in parts) <= 20


def test_limit_check_fails(spark):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    with pytest.raises(Exception, match="more than 1 points"):
        partition.check_limit(df, "k", 1).collect()


def test_motion_estimate_finds_a_shift(spark):
    _, a = cloud(spark, 200, 4, 5000)
    reference = a.withColumn("frame", F.lit(1))
    moved = reference.select("idx", "frame", (F.col("x") + 3).alias("x"), (F.col("y") - 2).alias("y"), F.col("z").alias("z"))
    got = {r.axis: [round(v, 6) for v in (r.m0, r.m1, r.m2, r.t)] for r in kernels.estimate_motion(reference, moved).collect()}
    assert got == {"x": [1, 0, 0, 3], "y": [0, 1, 0, -2], "z": [0, 0, 1, 0]}


def test_schedule_and_reference_counts():
    rows = schedules.hierarchical(0, 8, 1)
    assert [r[1] for r in rows] == [4, 2, 1, 3, 6, 5, 7]
    assert schedules.reference_counts(rows)[4] == 4


@pytest.mark.parametrize("ascii_", [True, False])
def test_ply_round_trip(ascii_):
    c = {a: np.array([1, 22, 333], np.int32) for a in "xyz"} | {"c0": np.array([0, 5, 255]), "c1": np.array([1, 2, 3]), "c2": np.array([9, 8, 7]), "refl": np.array([0, 300, 65535])}
    got = ply.parse(ply.format_ply(c, ascii_))
    assert all((got[k] == v).all() for k, v in c.items())
    assert (ply.parse(ply.format_ply(c, ascii_), 0.1)["z"] == [0, 2, 33]).all()


def test_ply_rejects_what_it_does_not_know():
    with pytest.raises(ValueError, match="not a PLY"):
        ply.parse(b"plain text")
    with pytest.raises(ValueError, match="unknown property type"):
        ply.parse(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty half x\nend_header\n1\n")


def test_packed_bits_round_trip():
    v = np.arange(200) * 5
    assert (records.unpack_bits(records.pack_bits(v, 10), 10, 200) == v).all()
    assert list(records.records_of(b"\x03\x00\x00\x00\x02ab\x01\x00\x00\x00\x00")) == [(3, b"ab"), (1, b"")]


def test_motion_file(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 0.5 0 0 1 0 0 0 1 10 -20 3 100 -5\nshort line\n")
    r = records.read_motion(spark, str(tmp_path / "m.txt")).collect()
    assert len(r) == 1 and (r[0].m00, r[0].m01, r[0].t1, r[0].z_bottom) == (65536, 32768, -20, -5)


def test_results_csv_with_comments(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# note\nconfig,,bits\na,1,8\n")
    df = records.read_results(spark, str(tmp_path / "r.csv"))
    assert df.columns[0] == "config" and df.columns[2] == "bits" and df.count() == 1


def test_options_are_checked():
    from cloudloom.plans.options import Options

    assert Options.of({"tile_size": "64", "partition": "uniform"}, {"tile_size": "128"}).tile_size == 128
    for bad in ({"partition": "x"}, {"neighbours": "4"}, {"slice_min_points": "9", "slice_max_points": "5"}, {"other": "1"}):
        with pytest.raises(ValueError):
            Options.of(bad)


def brute_polygon(p, bits):
    """Order, centroid and normal of one node's vertices, by plain loops over Python integers."""
    quotient = lambda a, b: (abs(a) // abs(b)) * (1 if (a >= 0) == (b >= 0) else -1)
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    n, width = len(p), (1 << bits) * 256
    middle = [quotient(sum(v[i] for v in p), n) for i in range(3)]

    def turned(axis):
        i, j = ((2, 1), (2, 0), (1, 0))[axis]

        def arc(v):
            x, y = v[i] + 128, v[j] + 128
            return y if x >= width else 2 * width - x if y >= width else 3 * width - y if x <= 0 else 3 * width + x

        return sorted(p, key=lambda v: (-arc(v), v[axis] + 128))

    best, order, axis = 0, p, 0
    if n > 3:
        order = turned(0)
        for a in range(3):
            q = turned(a)
            around = sum(abs(cross([q[k][i] - middle[i] for i in range(3)], [q[(k + 1) % n][i] - middle[i] for i in range(3)])[a]) for k in range(n))
            if around > best:
                best, order, axis = around, q, a
    weight = [0] * n
    for k in range(n):
        w = sum(abs(order[k][i] - order[(k + 1) % n][i]) for i in range(3))
        weight[k] += w
        weight[(k + 1) % n] += w
    g = [quotient(sum(w * v[i] for w, v in zip(weight, order, strict=True)), sum(weight)) if sum(weight) else order[0][i] for i in range(3)]
    total = [0, 0, 0]
    for k in range(n):
        c = cross([order[k][i] - g[i] for i in range(3)], [order[(k + 1) % n][i] - g[i] for i in range(3)])
        total = [t + x for t, x in zip(total, c, strict=True)]
    length = max(1, math.isqrt(sum(t * t for t in total)))
    return axis, g, [quotient(t * 256, length) for t in total] if n > 3 else [0, 0, 0], order


def test_polygons_against_brute_force(spark, sf_dir):
    from cloudloom.queries import surfaces

    rows = surfaces.tri04_agg24_drifted_centroids(spark, sf_dir).collect()
    v = surfaces.voxels(spark, sf_dir)
    nodes = v.select(*(F.shiftright(a, 3).alias(f"n{a}") for a in "xyz")).distinct()
    by = {}
    for r in surface.node_vertices(surface.edge_vertices(v, 3, 2), nodes, 3).collect():
        by.setdefault((r.nx, r.ny, r.nz), []).append((r.edge, [r.px, r.py, r.pz]))
    assert len(rows) == sum(len(x) >= 3 for x in by.values()) >= 50 and max(r.n for r in rows) > 4
    for r in rows:
        axis, g, normal, order = brute_polygon([p for _, p in sorted(by[r.nx, r.ny, r.nz])], 3)
        assert (r.axis, [r.gx, r.gy, r.gz], [r.ux, r.uy, r.uz], r.vertices) == (axis, g, normal, order)
        assert -r.low <= 0 <= r.high and all(-128 <= r[f"c{a}"] <= 7 * 256 + 127 for a in "xyz")
    # drift: sums over the node's points
    points = {}
    for q in v.collect():
        points.setdefault((q.x >> 3, q.y >> 3, q.z >> 3), []).append([(q[a] & 7) * 256 for a in "xyz"])
    for r in [r for r in rows if r.n > 3][:60]:
        g, u, w_sum, h_sum = [r.gx, r.gy, r.gz], [r.ux, r.uy, r.uz], 0, 0
        for q in points[r.nx, r.ny, r.nz]:
            e = [a - b for a, b in zip(q, g, strict=True)]
            c = [(u[i] * e[j] - u[j] * e[i]) >> 8 for i, j in ((1, 2), (2, 0), (0, 1))]
            away = math.isqrt(sum(x * x for x in c)) >> 8
            if away * 1024 <= 1774 * 3:
                w = (1024 + 4 * (1774 * 3 - 1024 * away)) >> 10
                w_sum, h_sum = w_sum + w, h_sum + w * (sum(a * b for a, b in zip(u, e, strict=True)) >> 8)
        mean = int(abs(h_sum >> 2) // max(1, w_sum)) * (1 if h_sum >> 2 >= 0 else -1)
        steps = 0 if abs(mean) < 21 else (abs(mean) - 21 + 64 + 21 >> 6) * (1 if mean > 0 else -1)
        steps = min(max(steps, -r.low), r.high)
        assert r.drift == (0 if not steps else (abs(steps) * 64 + 21 - 32) * (1 if steps > 0 else -1))


def test_triangle_voxels_against_every_ray():
    rng = np.random.default_rng(5)
    for _ in range(20):
        v = rng.integers(-128, 8 * 256 - 128, (3, 3))
        got = {tuple(p) for p in surface.voxels_of(v, 3).tolist()}
        e1, e2 = v[1] - v[0], v[2] - v[0]
        normal = np.cross(e1, e2) >> 8
        flat, want = int(np.argmin(np.abs(normal))), set()
        for d in {0, 1, 2} - {flat}:
            i, j = (k for k in range(3) if k != d)
            for a in range(9):
                for b in range(9):
                    o = np.zeros(3, np.int64)
                    o[i], o[j], o[d] = a * 256, b * 256, max(0, v[:, d].min() + 128 >> 8) * 256
                    if not all(max(0, v[:, k].min() + 128 >> 8) <= o[k] // 256 <= min(8, v[:, k].max() + 128 >> 8) for k in (i, j)):
                        continue
                    hit, at = surface.ray_hits(o[None], v[0], e1, e2, d)
                    if hit[0]:
                        for shift in (0, 32, -32):
                            p = o.copy()
                            p[d] = at[0] + shift
                            p = (p + 128) >> 8
                            if (p >= 0).all() and (p <= 7).all():
                                want.add(tuple(p.tolist()))
        assert got == want
    # a right triangle in a plane of constant x: rays along x meet it where they must
    flat = np.array([[512, 0, 0], [512, 1792, 0], [512, 0, 1792]])
    assert {(2, y, z) for y in range(8) for z in range(8) if y + z <= 7} <= {tuple(p) for p in surface.voxels_of(flat, 3).tolist()}


def test_predicting_transform_against_brute_force(spark, sf_dir):
    from cloudloom.queries import coding

    cloud = coding.small_cloud(spark, sf_dir)
    coded, edges = prediction.predicting_transform(cloud, "v", 28, 4, 4, spread=64)
    got = {r.idx: r for r in coded.collect()}
    value = {r.idx: r.v for r in cloud.collect()}
    near = {}
    for r in edges.orderBy("t", "rank").collect():
        near.setdefault(r.t, []).append((r.s, r.weight))
    step, inverse = 256 << 4, (1 << 26) // 256 >> 4
    level = lambda x: (x * inverse + (1 << 26) // 3) >> 26 if x >= 0 else -(((1 << 26) // 3 - x * inverse) >> 26)
    bits = lambda q: 2 * (abs(q) + 1).bit_length() - 1
    rebuilt = {}
    for i in sorted(got, key=lambda i: got[i].lod):
        r, mode, p = got[i], 0, 0
        if i in near:
            vs = [rebuilt[s] for s, _ in near[i]]
            total = sum(w * v for (_, w), v in zip(near[i], vs, strict=True))
            p = (total + 128) >> 8
            if max(vs) - min(vs) >= 64:
                tries = [(bits(level((value[i] - p) * 256)), 0, p)] + [(bits(level((value[i] - v) * 256)) + k + 1, k + 1, v) for k, v in enumerate(vs)]
                _, mode, p = min(tries)
        q = level((value[i] - p) * 256)
        rebuilt[i] = min(max(p + ((q * step + 128) >> 8), 0), 255)
        assert (r.mode, r.residual, r.reconstructed) == (mode, q, rebuilt[i])
    assert {r.mode for r in got.values()} > {0}


def test_propagated_weights_against_brute_force(spark, sf_dir):
    from cloudloom.queries import coding

    cloud = coding.small_cloud(spark, sf_dir)
    edges = lod.lifting(cloud, "v", 4, 4)[1]
    got = {r.idx: r.weight for r in prediction.propagated_weights(cloud, edges).collect()}
    want = dict.fromkeys(got, 256)
    for level in (3, 2, 1):
        for r in [r for r in edges.collect() if r.lod == level]:
            want[r.s] += (r.weight * want[r.t] + 128) >> 8
    # all of a level is complete before it passes on, so the order inside a level does not matter
    assert got == want and max(got.values()) > 512


def test_lifting_coefficients_against_brute_force(spark, sf_dir):
    from cloudloom.queries import coding

    cloud = coding.small_cloud(spark, sf_dir)
    coefficients, edges = lod.lifting(cloud, "v", 4, 4)
    value = {r.idx: r.v for r in cloud.collect()}
    rows = edges.collect()
    for level in (3, 2, 1):
        mine = [r for r in rows if r.lod == level]
        for t in {r.t for r in mine}:
            p = sum(r.weight * value[r.s] for r in mine if r.t == t)
            value[t] -= (p + 128) >> 8 if p >= 0 else -((128 - p) >> 8)
        more = {}
        for s in {r.s for r in mine}:
            a, w = sum(r.weight * value[r.t] for r in mine if r.s == s), sum(r.weight for r in mine if r.s == s)
            more[s] = abs(a) // (2 * w) * (1 if a >= 0 else -1) if w else 0
        for s, u in more.items():
            value[s] += u
    assert {r.idx: r.value for r in coefficients.collect()} == value


def test_merged_cells_join_neighbours_while_they_can(spark):
    rng = np.random.default_rng(3)
    cells = [(t, x, y, z, int(rng.integers(1, 60))) for t in range(2) for x in range(5) for y in range(4) for z in range(2) if rng.random() < 0.8]
    rows = partition.merged_cells(spark.createDataFrame(cells, "tile long, gx long, gy long, gz long, n long"), 120).collect()
    size = {c[:4]: c[4] for c in cells}
    groups = {}
    for r in rows:
        groups.setdefault((r.tile, r.head), []).append((r.gx, r.gy, r.gz))
    assert len(rows) == len(cells) and len(groups) < len(cells)
    assert all(sum(size[(t, *c)] for c in cs) < 120 for (t, _), cs in groups.items() if len(cs) > 1)
    for t in (0, 1):
        assert sorted(h for u, h in groups if u == t) == list(range(sum(u == t for u, _ in groups)))
    # a lone cell has no neighbour with which it stays under the limit
    owner = {(t, *c): (t, h) for (t, h), cs in groups.items() for c in cs}
    for (t, h), cs in groups.items():
        if len(cs) == 1:
            c = cs[0]
            around = [(t, *(v + s * (i == a) for i, v in enumerate(c))) for a in range(3) for s in (-1, 1)]
            assert all(size[(t, *c)] + sum(size[(t, *x)] for x in groups[owner[n]]) >= 120 for n in around if n in owner)


def test_zeroing_follows_the_run_of_zeros():
    assert [hierarchy.zero_rate(z, 0) for z in (0, 4, 10)] == [1, 5, 11]
    assert hierarchy.zero_rate(11, 1) == 11 + 2 * 1 + 1 + 1 and hierarchy.zero_rate(0, 3) == 1 + 2


def test_zeroed_drops_only_small_levels(spark):
    rng = np.random.default_rng(4)
    c = rng.normal(0, 40, 400).round(3)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(c)], "key string, place long, coefficient double")
    got = [r.q for r in hierarchy.zeroed(df, "key", 40).orderBy("place").collect()]
    step = 256 << 6
    inverse, third = (1 << 26) // 256 >> 6, (1 << 26) // 3
    zeros, want = 0, []
    for v in c:
        v = round(float(v))
        q = (v * 256 * inverse + third) >> 26 if v >= 0 else -((third - v * 256 * inverse) >> 26)
        if 0 < abs(q) < 3 and v * v << 26 < step * step * 25 * hierarchy.zero_rate(zeros, abs(q)):
            q = 0
        zeros = zeros + 1 if q == 0 else 0
        want.append(q)
    assert got == want and 0 < sum(q == 0 for q in got) < 400


def test_tree_chunks_are_trees_of_near_points(spark):
    p, a = cloud(spark, 300, 9)
    rows = trees.trees(a, 64, "radius").collect()
    by = {}
    for r in rows:
        by.setdefault(r.chunk, []).append(r)
    assert max(map(len, by.values())) == 64 and sum(map(len, by.values())) == 300
    radius = [int((p[r.idx][:2] ** 2).sum()) for r in sorted(rows, key=lambda r: r.place)]
    assert radius == sorted(radius)
    for rs in by.values():
        rs = sorted(rs, key=lambda r: r.place)
        children = {}
        for i, r in enumerate(rs):
            if i == 0:
                assert r.parent == -1
                continue
            free = [q for q in rs[:i] if children.get(q.place, 0) < 3]
            d = {q.place: int(((p[q.idx] - p[r.idx]) ** 2).sum()) for q in free}
            assert d[r.parent] == min(d.values())
            children[r.parent] = children.get(r.parent, 0) + 1


def test_serpentine_turns_runs_where_the_jump_is_smaller(spark, sf_dir):
    f = frames(spark, sf_dir).filter("frame < 3")
    rows = {(r.slice, r.place): r.idx for r in kernels.serpentine(f, "frame", "slice").collect()}
    own = {r.idx: r for r in f.collect()}
    for frame in {k for k, _ in rows}:
        order = [own[rows[frame, i]] for i in range(sum(k == frame for k, _ in rows))]
        runs, last = [], None
        for r in order:
            if (r.y // 600, r.slice) != last:
                runs.append([])
                last = (r.y // 600, r.slice)
            runs[-1].append(r.z)
        assert [r.y // 600 for r in order] == sorted(r.y // 600 for r in order)
        for before, run in zip(runs, runs[1:], strict=False):
            assert run in (sorted(run), sorted(run, reverse=True)) and abs(run[0] - before[-1]) <= abs(run[-1] - before[-1])


def test_knn_in_groups_with_crowded_places(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.integers(0, 4000, (60, 3)), np.full((200, 3), 700), rng.integers(690, 720, (200, 3))])
    rows = [(i, i % 2, *map(int, v)) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "idx long, g int, x int, y int, z int")
    got = {}
    for r in joins.knn_join(df, df, 4, by=("g",)).collect():
        got.setdefault(r.t, []).append((r["rank"], r.s, r.d2))
    for i, g, *q in rows:
        others = sorted((int(((p[j] - np.array(q)) ** 2).sum()), j) for j, h, *_ in rows if h == g)[:4]
        assert sorted(got[i]) == [(k + 1, j, d) for k, (d, j) in enumerate(others)]


def test_many_boxes_and_values_give_what_few_give(spark, monkeypatch):
    rng = np.random.default_rng(8)
    _, a = cloud(spark, 120, 3)
    boxes = [(i, *map(int, lo), *(int(v) for v in lo + rng.integers(5, 120, 3)), i + 100) for i, lo in enumerate(rng.integers(0, 380, (40, 3)))]
    b = spark.createDataFrame(boxes, "ord int, min_x int, min_y int, min_z int, max_x int, max_y int, max_z int, qp int")
    few = sorted(map(tuple, joins.first_box(a, b, "qp", -1).collect()))
    assert few == sorted(map(tuple, joins.tiled_boxes(a, b, "qp", -1).collect())) and len({r[-1] for r in few}) > 3
    t = spark.createDataFrame([(k, int(v)) for k, v in enumerate(rng.integers(0, 400, 50))], "k long, v int")
    small = sorted(map(tuple, joins.nearest_value(a, F.col("x"), t, "v", "k", "near").collect()))
    monkeypatch.setattr(joins, "EXPRESSION_ROWS", 5)
    assert small == sorted(map(tuple, joins.nearest_value(a, F.col("x"), t, "v", "k", "near").collect()))


def test_motion_file_of_many_splits(spark, tmp_path):
    line = " ".join(["1", "0", "0", "0", "1", "0", "0", "0", "1", "{}", "0", "0", "5", "-5"])
    (tmp_path / "motion.txt").write_text("\n".join(line.format(i) for i in range(4000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = records.read_motion(spark, f"file://{tmp_path}/motion.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.frame, r.t0) for r in rows) == [(i, i) for i in range(4000)]


@pytest.mark.parametrize("chunk", [3, 17, 1 << 18])
def test_windows_in_chunks_see_the_rows_before(spark, chunk):
    rng = np.random.default_rng(11)
    rows = [(i, int(k), int(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 90), rng.integers(0, 3, 90), strict=True)) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "idx long, k int, v int")
    got = {r.idx: [(b.idx, b.v) for b in r.before] for r in partition.before_in_chunks(df, ["k"], "idx", ["v"], 3, chunk).collect()}
    runs = {(r.k, r.idx): (r.v, r.n) for r in partition.runs(df, "v", "idx", "k", chunk=chunk).collect()}
    want_runs = {}
    for key in range(3):
        mine = [(i, v) for i, k, v in rows if k == key]
        for n, (i, v) in enumerate(mine):
            assert got[i] == mine[max(0, n - 3) : n][::-1]
            if n == 0 or mine[n - 1][1] != v:
                first = i
                want_runs[key, first] = (v, 0)
            want_runs[key, first] = (v, want_runs[key, first][1] + 1)
    assert runs == want_runs


def test_places_by_key_and_index_with_an_outlier(spark):
    from cloudloom.sources import clouds

    rng = np.random.default_rng(12)
    rows = [(i, int(v), int(k)) for i, (v, k) in enumerate(zip(rng.integers(0, 50, 200), rng.integers(0, 2, 200), strict=True))] + [(500, 10**15, 0)]
    df = spark.createDataFrame(rows, "idx long, v long, k int")
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for ranges in (None, 1, 7, 300):
        placed = clouds.dense_index(df, ["v", "idx"], "place", ranges)
        assert [r.idx for r in placed.orderBy("place").collect()] == [r[0] for r in ordered]
    for key in (0, 1):
        mine = [r[0] for r in ordered if r[2] == key]
        got = {r.idx: r.place for r in partition.place_within(df, ["k"], ["v", "idx"]).filter(F.col("k") == key).collect()}
        assert got == {i: n for n, i in enumerate(mine)}


def test_face_vertices_lie_between_their_centroids_and_near_points(spark):
    spread = spark.createDataFrame([(i, x, y, z) for i, (x, y, z) in enumerate({(int(a), int(b), int(c)) for a, b, c in np.random.default_rng(2).integers(0, 40, (6000, 3))})], "idx long, x int, y int, z int")
    nodes = spread.select(*(F.shiftright(a, 3).alias(f"n{a}") for a in "xyz")).distinct()
    own = surface.drifted(surface.polygons(surface.node_vertices(surface.edge_vertices(spread, 3, 2), nodes, 3), 3), spread, 3)
    faces = surface.face_candidates(own, 3).collect()
    shapes = {(r.nx, r.ny, r.nz): r for r in own.collect()}
    assert faces
    for f in faces:
        a, b = shapes[f.nx, f.ny, f.nz], shapes[f.mx, f.my, f.mz]
        assert [f.mx - f.nx, f.my - f.ny, f.mz - f.nz] == [int(i == f.face) for i in range(3)]
        place, axis = [f.fx, f.fy, f.fz], f.face
        assert place[axis] == 8 * 256 - 128 and [f.m_fx, f.m_fy, f.m_fz][axis] == -128
        for i in range(3):
            lo, hi = sorted((a[f"c{'xyz'[i]}"], b[f"c{'xyz'[i]}"] + (2048 if i == axis else 0)))
            assert i == axis or lo - 16 <= place[i] <= hi + 16
        assert sum(v[axis] + 128 == 2048 for v in a.vertices) in (2, 3) and a.vertices[f.before][axis] + 128 == 2048
    kept = {(f.nx, f.ny, f.nz, f.face) for f in surface.face_vertices(surface.face_candidates(own, 3), spread, 3, 2).collect()}
    dense = {}
    for r in spread.collect():
        dense.setdefault((r.x >> 3, r.y >> 3, r.z >> 3), []).append((r.x & 7, r.y & 7, r.z & 7))
    for f in faces:
        near = 0
        for node, place in (((f.nx, f.ny, f.nz), (f.fx, f.fy, f.fz)), ((f.mx, f.my, f.mz), (f.m_fx, f.m_fy, f.m_fz))):
            near += sum((max(abs(p - 256 * v) for p, v in zip(place, q, strict=True)) + 128) >> 8 < 8 for q in dense[node])
        assert ((f.nx, f.ny, f.nz, f.face) in kept) == (near > 0)


def test_transformed_attributes_come_back_close(spark, sf_dir):
    from cloudloom.queries import coding

    df = coding.coarse(spark, sf_dir).withColumn("tone", F.pmod(F.col("x") * 7, F.lit(256)))
    got = {r.m: r for r in hierarchy.raht_attributes(df, ["refl", "tone"], coding.DEPTH, 4).collect()}
    from cloudloom.functions import exprs

    want = df.groupBy(exprs.morton("x", "y", "z").alias("m")).agg(F.avg("refl").alias("refl"), F.avg("tone").alias("tone")).collect()
    assert len(got) == len(want) and all(abs(got[r.m].refl - r.refl) <= 4 and abs(got[r.m].tone - r.tone) <= 4 for r in want)
    coded, _ = hierarchy.raht_predicted(df, "refl", coding.DEPTH, 34)
    plain, _ = hierarchy.raht_predicted(df, "refl", coding.DEPTH, 34, predict=False)
    assert coded.count() == plain.count() == len(want)


def test_large_slices_are_refused(spark, monkeypatch):
    _, a = cloud(spark, 40, 1)
    monkeypatch.setattr(kernels, "SLICE_POINTS", 30)
    with pytest.raises(Exception, match="more than 30 points"):
        kernels.nearest_tree(a.withColumn("s", F.lit(1)), "s").collect()
