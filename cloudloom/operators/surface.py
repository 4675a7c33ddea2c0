"""Surface geometry: vertices on node edges, polygons with centroids, face vertices, and their triangles as voxels.

Each step is a table keyed by node: votes of points for edges, vertices of edges, a polygon for each node, drift and face flags
from sums over the node's points, triangles, voxels. Positions inside a node have 8 fractional bits and are
moved by half a voxel, so a node of width W reaches from -128 to 256 W - 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators.joins import apart, knn_join
from cloudloom.sources.shared import staged

AXES = E.AXES
NODE = ["nx", "ny", "nz"]
FRACTION = 8
#: Most points of a node that are compared in one row.
NODE_POINTS = 1024
ONE, HALF = 1 << FRACTION, 1 << FRACTION - 1
#: The twelve edges of a node in their order, each the axis it runs along and the corner it starts at.
EDGES = ((0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0), (1, 1, 0, 0), (2, 0, 0, 0), (2, 0, 1, 0), (2, 1, 1, 0), (2, 1, 0, 0), (0, 0, 0, 1), (1, 0, 0, 1), (0, 0, 1, 1), (1, 1, 0, 1))
#: Fixed value: a point counts for the drift up to this distance from the normal's line, in 1/1024 of a voxel for each unit of reach.
DRIFT_REACH = 1774


def nodes_of(df: DataFrame, bits: int, *columns: str) -> DataFrame:
    """``df`` with the node (nx, ny, nz) of 2^bits of each row and its place (vx, vy, vz) inside."""
    return df.select(*columns, *(F.shiftright(a, bits).alias(f"n{a}") for a in AXES), *(F.col(a).bitwiseAND((1 << bits) - 1).alias(f"v{a}") for a in AXES))


def edge_vertices(df: DataFrame, bits: int, reach: int = 2, dropped: int = 0) -> DataFrame:
    """(axis, sx, sy, sz, n1, n2, vertex) of every node edge that the surface crosses; s is the edge's start in node widths.

    Points within one voxel of an edge count twice, those within ``reach`` once; an edge is crossed if it has one of the first or two
    of the second. Nodes that share an edge add up in one aggregate.
    """
    width = 1 << bits
    p = nodes_of(df, bits)

    def vote(axis: int, *corner: int) -> Column:
        near = lambda r: [F.col(f"v{a}") < r if not c else F.col(f"v{a}") > width - r - 1 for i, (a, c) in enumerate(zip(AXES, corner, strict=True)) if i != axis]
        one, two = (x[0] & x[1] for x in (near(1), near(reach)))
        return F.struct(F.lit(axis).alias("axis"), *((F.col(f"n{a}") + c).alias(f"s{a}") for a, c in zip(AXES, corner, strict=True)), one.cast("int").alias("one"), two.cast("int").alias("two"), F.col(f"v{AXES[axis]}").alias("at"))

    votes = F.filter(F.array(*(vote(*e) for e in EDGES)), lambda e: (e["one"] + e["two"]) > 0)
    each = p.select(F.explode(votes).alias("e")).select("e.*")
    sums = each.groupBy("axis", "sx", "sy", "sz").agg(F.sum("one").alias("n1"), F.sum(F.col("one") * F.col("at")).alias("s1"), F.sum("two").alias("n2"), F.sum(F.col("two") * F.col("at")).alias("s2"))
    mean = E.idiv(F.call_function("shiftleft", 2 * F.col("s1") + F.col("s2"), F.lit(10 - dropped)), 2 * F.col("n1") + F.col("n2"))
    crossed = sums.filter((F.col("n1") > 0) | (F.col("n2") > 1))
    return crossed.select("axis", "sx", "sy", "sz", "n1", "n2", F.call_function("shiftright", mean + (1 << 9 - dropped), F.lit(10)).alias("vertex"))


def edge_neighbours(df: DataFrame, bits: int) -> DataFrame:
    """(axis, sx, sy, sz, mask) of every edge of an occupied node: bits 0 to 3 tell which of the four nodes around it are occupied, 4 to 7 and 8 to 11 which around the edges before and behind it on its line."""
    nodes = df.select(*(F.shiftright(a, bits).alias(f"n{a}") for a in AXES)).distinct()
    looks = []
    for axis, *corner in EDGES:
        side = [c for i, c in enumerate(corner) if i != axis]
        bit = 2 * side[0] + side[1]
        for group, step in enumerate((0, 1, -1)):
            at = [F.col(f"n{a}") + c + (step if i == axis else 0) for i, (a, c) in enumerate(zip(AXES, corner, strict=True))]
            looks.append(F.struct(F.lit(axis).alias("axis"), *(v.alias(f"s{a}") for a, v in zip(AXES, at, strict=True)), F.lit(1 << bit + 4 * group).alias("bit")))
    each = nodes.select(F.explode(F.array(*looks)).alias("e")).select("e.*")
    return each.groupBy("axis", "sx", "sy", "sz").agg(F.bit_or("bit").alias("mask")).filter(F.col("mask").bitwiseAND(15) > 0)


def node_vertices(vertices: DataFrame, nodes: DataFrame, bits: int, dropped: int = 0) -> DataFrame:
    """(nx, ny, nz, edge, px, py, pz): the vertices of every node of ``nodes`` (nx, ny, nz), at most twelve each."""
    width, looks = 1 << bits, []
    for number, (axis, *corner) in enumerate(EDGES):
        along = F.call_function("shiftleft", F.col("vertex").cast("bigint"), F.lit(FRACTION + dropped)) + (HALF << dropped)
        place = [(F.lit(((c * width) << FRACTION) - HALF) + (along if i == axis else 0)).cast("bigint").alias(f"p{a}") for i, (a, c) in enumerate(zip(AXES, corner, strict=True))]
        looks.append(F.when(F.col("axis") == axis, F.struct(*((F.col(f"s{a}") - c).alias(f"n{a}") for a, c in zip(AXES, corner, strict=True)), F.lit(number).alias("edge"), *place)))
    each = vertices.select(F.explode(F.array_compact(F.array(*looks))).alias("e")).select("e.*")
    return each.join(nodes.select(*NODE).distinct(), NODE, "left_semi")


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer quotient toward zero; 0 where the divisor is."""
    safe = np.where(b == 0, 1, b)
    return np.where(b == 0, 0, np.sign(a) * np.sign(safe) * (np.abs(a) // np.abs(safe)))


def _root(x: np.ndarray) -> np.ndarray:
    """Integer square root, rounded down."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def polygons_of(p: np.ndarray, n: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    """Ordered vertices, centroid and normal of nodes; ``p``: (nodes, 12, 3) places in edge order, ``n`` how many of them count."""
    rows, k = np.arange(len(p))[:, None], np.arange(12)
    real = k < n[:, None]
    width = (1 << bits) << FRACTION
    follow = np.where(k + 1 < n[:, None], k + 1, 0)
    middle = _quotient((p * real[:, :, None]).sum(1), np.maximum(n, 1)[:, None])
    best, axis, order = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.tile(k, (len(p), 1))
    for a, (i, j) in enumerate(((2, 1), (2, 0), (1, 0))):
        s = p + HALF
        x, y = s[:, :, i], s[:, :, j]
        arc = np.where(x >= width, y, np.where(y >= width, 2 * width - x, np.where(x <= 0, 3 * width - y, 3 * width + x)))
        key = np.where(real, -arc * (4 * width) + s[:, :, a], np.iinfo(np.int64).max)
        turn = np.argsort(key, axis=1, kind="stable")
        q = p[rows, turn] - middle[:, None]
        size = (np.abs(np.cross(q, q[rows, follow]))[:, :, a] * real).sum(1)
        better = (size > best) & (n > 3)
        best, axis = np.where(better, size, best), np.where(better, a, axis)
        order = np.where(better[:, None] | ((a == 0) & (n > 3))[:, None], turn, order)
    p = p[rows, order]
    gap = np.abs(p - p[rows, follow]).sum(2) * real
    weight = (gap + np.where(k > 0, np.roll(gap, 1, 1), gap[rows[:, 0], np.maximum(n - 1, 0)][:, None])) * real
    centre = _quotient((p * weight[:, :, None]).sum(1), weight.sum(1)[:, None])
    centre = np.where(weight.sum(1)[:, None] == 0, p[:, 0], centre)
    q = p - centre[:, None]
    total = (np.cross(q, q[rows, follow]) * real[:, :, None]).sum(1)
    length = np.maximum(1, _root((total.astype(np.float64) ** 2).sum(1).astype(np.int64) if np.abs(total).max(initial=0) > 1 << 30 else (total**2).sum(1)))
    normal = np.where((n > 3)[:, None], _quotient(total << FRACTION, length[:, None]), 0)
    top = ((1 << bits) - 1) << FRACTION
    bounds = []
    for sign in (1, -1):
        steps = np.arange(1, 1 << bits)
        at = centre[:, None] + sign * steps[None, :, None] * normal[:, None]
        out = ((at < 0) | (at > top)).any(2)
        bounds.append(np.where(out.any(1), out.argmax(1), len(steps)))
    return {"axis": axis, "centre": centre, "normal": normal, "high": bounds[0], "low": bounds[1], "vertices": p}


POLYGON = "nx int, ny int, nz int, n int, axis int, gx long, gy long, gz long, ux long, uy long, uz long, low long, high long, vertices array<array<long>>"


def polygons(each: DataFrame, bits: int) -> DataFrame:
    """A polygon for each node with at least three vertices: its vertices in order around the dominant axis, the centroid (g) weighted by the
    lengths of the sides at each vertex, the unit normal (u, 8 fractional bits) of the summed cross products for more than three
    vertices, and how far the centroid may drift along it."""
    lists = each.groupBy(*NODE).agg(F.sort_array(F.collect_list(F.struct("edge", "px", "py", "pz"))).alias("v")).filter(F.size("v") >= 3)  # at most twelve entries

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, size = batch.column(3), batch.num_rows
            ends = v.offsets.to_numpy().astype(np.int64)
            n = np.diff(ends)
            flat = v.flatten()
            xyz = np.stack([flat.field(f"p{a}").to_numpy() for a in AXES], 1) if size else np.empty((0, 3), np.int64)
            p = np.zeros((size, 12, 3), np.int64)
            at = np.repeat(np.arange(size), n)
            p[at, np.arange(len(at)) - np.repeat(ends[:-1] - ends[0], n)] = xyz
            got = polygons_of(p, n, bits)
            columns = [*(c.cast(pa.int32()) for c in batch.columns[:3]), pa.array(n, pa.int32()), pa.array(got["axis"], pa.int32())]
            columns += [pa.array(got[key][:, i], pa.int64()) for key in ("centre", "normal") for i in range(3)]
            columns += [pa.array(got["low"], pa.int64()), pa.array(got["high"], pa.int64()), pa.array([r[:m].tolist() for r, m in zip(got["vertices"], n, strict=True)], pa.list_(pa.list_(pa.int64())))]
            yield pa.record_batch(columns, [f.split(" ")[0] for f in POLYGON.split(", ")])

    return lists.mapInArrow(make, POLYGON)


def drifted(shapes: DataFrame, df: DataFrame, bits: int, dropped: int = 0) -> DataFrame:
    """``shapes`` with ``drift`` and the moved centroid (cx, cy, cz): along the normal, by the weighted mean of the node's points near its line, in steps.

    Points meet their node's polygon in an equi-join and become two sums.
    """
    reach = DRIFT_REACH * max(3, dropped)
    p = nodes_of(df, bits).join(shapes.filter("n > 3").select(*NODE, *(f"g{a}" for a in AXES), *(f"u{a}" for a in AXES)), NODE)
    gap = [(F.shiftleft(F.col(f"v{a}").cast("bigint"), FRACTION) - F.col(f"g{a}")) for a in AXES]
    u = [F.col(f"u{a}") for a in AXES]
    cross = [F.shiftright(u[i] * gap[j] - u[j] * gap[i], FRACTION) for i, j in ((1, 2), (2, 0), (0, 1))]
    away = F.shiftright(F.floor(F.sqrt((cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]).cast("double"))), FRACTION)
    weight = F.shiftright(1024 + 4 * (reach - 1024 * away), 10)
    height = F.shiftright(u[0] * gap[0] + u[1] * gap[1] + u[2] * gap[2], FRACTION)
    sums = p.select(*NODE, away.alias("away"), weight.alias("w"), height.alias("h")).filter(F.col("away") * 1024 <= reach).groupBy(*NODE).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("h")).alias("h"))
    half = 1 << 5 + dropped
    dead = 2 * half // 3
    mean = E.idiv(F.shiftright("h", FRACTION - 6), F.greatest(F.col("w"), F.lit(1)))
    steps = F.when(F.abs(mean) >= dead, F.signum(mean.cast("double")).cast("bigint") * F.shiftright(F.abs(mean) - dead + 2 * half + dead, 6 + dropped)).otherwise(0)
    held = shapes.join(sums.select(*NODE, steps.alias("steps")), NODE, "left").withColumn("steps", E.clip(F.coalesce("steps", F.lit(0)), -F.col("low"), F.col("high")))
    size = F.signum(F.col("steps").cast("double")).cast("bigint") * (F.shiftleft(F.abs("steps"), 6 + dropped) + (dead - half))
    held = held.withColumn("drift", F.when(F.col("steps") == 0, F.lit(0).cast("bigint")).otherwise(size))
    top = (((1 << bits) - 1) << FRACTION) + HALF - 1
    moved = {f"c{a}": F.when(F.col("n") > 3, E.clip(F.col(f"g{a}") + F.shiftright(F.col("drift") * F.col(f"u{a}"), 6), -HALF, top)).otherwise(F.col(f"g{a}")) for a in AXES}
    return held.withColumns(moved).drop("steps")


FACE = "nx int, ny int, nz int, face int, before int, fx long, fy long, fz long, mx int, my int, mz int, m_before int, m_fx long, m_fy long, m_fz long"


def _bridge(v: np.ndarray, axis: int, plane: int, face: np.ndarray) -> int:
    """The vertex whose side to the next one lies in the plane and nearest to ``face``; -1 without one."""
    best, found = 1 << 30, -1
    for i in range(1 if len(v) == 3 else len(v)):
        a, b = v[i] + HALF, v[(i + 1) % len(v)] + HALF
        if a[axis] == plane == b[axis]:
            gap = (_quotient(a + b, np.array(2)) - face) >> FRACTION
            if (d := int((gap * gap).sum())) < best:
                best, found = d, i
    return found


def face_candidates(shapes: DataFrame, bits: int) -> DataFrame:
    """For each node and its neighbour along an axis, both with a drifted centroid inside: the place where the line between the centroids passes
    their face, in both nodes, and the vertices that it comes behind. Only where two or three vertices lie on the face, and both centroids and the place lie on one side of the surface."""
    width = 1 << bits
    inside = lambda p: (F.least(*(F.col(f"{p}c{a}") for a in AXES)) >= 0) & (F.greatest(*(F.col(f"{p}c{a}") for a in AXES)) <= width << FRACTION)
    own = shapes.filter((F.col("n") > 3) & inside("")).select(*NODE, *(f"{k}{a}" for k in "cg" for a in AXES), "vertices")
    near = own.select(*(F.col(n).alias(f"m{n[1]}") for n in NODE), *(F.col(f"{k}{a}").alias(f"m_{k}{a}") for k in "cg" for a in AXES), F.col("vertices").alias("m_vertices"))
    steps = F.array(*(F.struct(F.lit(a).alias("axis"), *((F.col(n) + int(i == a)).alias(f"m{n[1]}") for i, n in enumerate(NODE))) for a in (2, 1, 0)))
    both = own.select("*", F.explode(steps).alias("e")).select(*own.columns, F.col("e.axis").alias("face"), *(F.col(f"e.m{a}").alias(f"m{a}") for a in AXES)).join(near, ["mx", "my", "mz"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                axis, full = r["face"], width << FRACTION
                v, mv = np.array(r["vertices"]), np.array(r["m_vertices"])
                if (v[:, axis] + HALF == full).sum() not in (2, 3):
                    continue
                c, g, mc, mg = (np.array([r[f"{p}{k}{a}"] for a in AXES]) for p in ("", "m_") for k in "cg")
                shift = np.zeros(3, np.int64)
                shift[axis] = full
                plane = full - HALF
                run = mc[axis] + full - c[axis]
                t = int(_quotient(np.array((plane - c[axis]) << FRACTION), np.array(run)))
                f = c + ((t * (mc + shift - c) + HALF) >> FRACTION)
                f[axis] = plane
                mf = f.copy()
                mf[axis] = -HALF
                i, j = _bridge(v, axis, full, f), _bridge(mv, axis, 0, mf)
                if i < 0 or j < 0:
                    continue
                side = v[(i + 1) % len(v)] - v[i]
                side = _quotient(side << FRACTION, _root((side * side).sum(keepdims=True)))
                rise = f - v[i]
                rise = rise - ((((rise * side).sum() >> FRACTION) * side) >> FRACTION)
                if ((c - g) * rise).sum() > 0 and ((mc - mg) * rise).sum() > 0:
                    out.append((*(r[n] for n in NODE), axis, i, *f.tolist(), *(r[f"m{a}"] for a in AXES), j, *mf.tolist()))
            kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in FACE.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], [f.split(" ")[0] for f in FACE.split(", ")])

    return both.mapInArrow(make, FACE)


def face_vertices(candidates: DataFrame, df: DataFrame, bits: int, reach: int = 2) -> DataFrame:
    """Those of ``candidates`` with points of either node around them: one within 8 voxels in every axis, or two within 4 ``reach``. Points meet candidates by node and become two sums."""
    p = nodes_of(df, bits)
    key = [*NODE, "face"]
    ask = candidates.select(*key, *(F.col(n).alias(f"q{n[1]}") for n in NODE), *(F.col(f"f{a}").alias(f"t{a}") for a in AXES))
    other = candidates.select(*key, *(F.col(f"m{a}").alias(f"q{a}") for a in AXES), *(F.col(f"m_f{a}").alias(f"t{a}") for a in AXES))
    points = p.select(*(F.col(f"n{a}").alias(f"q{a}") for a in AXES), *(f"v{a}" for a in AXES))
    met = ask.unionByName(other).join(points, ["qx", "qy", "qz"])
    gap = F.greatest(*(F.abs(F.col(f"t{a}") - F.shiftleft(F.col(f"v{a}").cast("bigint"), FRACTION)) for a in AXES))
    away = F.shiftright(gap + HALF, FRACTION)
    sums = met.groupBy(*key).agg(F.sum((away < 8).cast("int")).alias("w1"), F.sum((away < 4 * reach).cast("int")).alias("w2"))
    return candidates.join(sums.filter("w1 > 0 or w2 > 1"), key, "left_semi")


def with_faces(shapes: DataFrame, faces: DataFrame) -> DataFrame:
    """``shapes`` with the face vertices put in behind the vertices that they follow."""
    own = faces.select(*NODE, F.struct(F.col("before").alias("at"), F.lit(0).alias("side"), "face", F.array("fx", "fy", "fz").alias("p")).alias("f"))
    far = faces.select(*(F.col(f"m{n[1]}").alias(n) for n in NODE), F.struct(F.col("m_before").alias("at"), F.lit(1).alias("side"), "face", F.array("m_fx", "m_fy", "m_fz").alias("p")).alias("f"))
    lists = own.unionByName(far).groupBy(*NODE).agg(F.sort_array(F.collect_list("f")).alias("fs"))  # at most six entries
    both = shapes.join(lists, NODE, "left").withColumn("fs", F.coalesce("fs", F.expr("cast(array() as array<struct<at:int,side:int,face:int,p:array<bigint>>>)")))
    merged = F.flatten(F.transform("vertices", lambda v, i: F.concat(F.array(v), F.transform(F.filter("fs", lambda f: f["at"] == i), lambda f: f["p"]))))
    return both.withColumn("vertices", merged).drop("fs")


def triangles(shapes: DataFrame) -> DataFrame:
    """(nx, ny, nz, a, b, c): the triangles of each polygon; one for three vertices, else a fan around the centroid."""
    n = F.size("vertices")
    v = F.col("vertices")
    fan = F.transform(v, lambda p, i: F.struct(p.alias("a"), F.get(v, F.pmod(i + 1, n)).alias("b"), F.array("cx", "cy", "cz").alias("c")))
    one = F.array(F.struct(F.get(v, F.lit(0)).alias("a"), F.get(v, F.lit(1)).alias("b"), F.get(v, F.lit(2)).alias("c")))
    return shapes.select(*NODE, F.explode(F.when(n == 3, one).otherwise(fan)).alias("t")).select(*NODE, "t.*")


def ray_hits(origin: np.ndarray, v0: np.ndarray, edge1: np.ndarray, edge2: np.ndarray, direction: int, halo: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which rays along ``direction`` from ``origin`` (rays, 3) meet the triangle, and where on that axis; none if it is nearly parallel to them. All in 8 fractional bits, quotients toward zero."""
    ray = np.zeros(3, np.int64)
    ray[direction] = ONE
    h = np.cross(ray, edge2) >> FRACTION
    a = int((edge1 * h).sum() >> FRACTION)
    if abs(a) <= ONE:
        return np.zeros(len(origin), bool), origin[:, direction]
    s, by = origin - v0, np.array(a)
    q = np.cross(s, edge1)
    u, v = _quotient((s * h).sum(1), by), _quotient(q[:, direction], by)
    t = _quotient((edge2 * (q >> FRACTION)).sum(1), by)
    return (u >= -halo) & (v >= -halo) & (ONE - u - v >= -halo), origin[:, direction] + t


def hits_along_x(df: DataFrame, edge1: list[Column], edge2: list[Column], origin: list[Column], halo: int = 0) -> DataFrame:
    """``ray_hits`` in columns, for a ray along x in each row: the rows that meet their triangle, with ``t``; edges and origin are seen from its first corner."""
    (ex, ey, ez), (fx, fy, fz), (sx, sy, sz) = edge1, edge2, origin
    h = [F.shiftright(-ONE * fz, FRACTION), F.shiftright(ONE * fy, FRACTION)]
    q = [sy * ez - sz * ey, sz * ex - sx * ez, sx * ey - sy * ex]
    a = F.shiftright(ey * h[0] + ez * h[1], FRACTION)
    u, v = E.idiv(sy * h[0] + sz * h[1], a), E.idiv(q[0], a)
    t = E.idiv(sum((f * F.shiftright(k, FRACTION) for f, k in zip((fy, fz), q[1:], strict=True)), fx * F.shiftright(q[0], FRACTION)), a)
    solved = df.select("*", a.alias("__a")).filter(F.abs("__a") > ONE).select("*", u.alias("__u"), v.alias("__v"), t.alias("t"))
    return solved.filter((F.col("__u") >= -halo) & (F.col("__v") >= -halo) & (ONE - F.col("__u") - F.col("__v") >= -halo)).drop("__a", "__u", "__v")


def voxels_of(v: np.ndarray, bits: int, step: int = 1, thickness: int = 32) -> np.ndarray:
    """The voxels of a node that rays along the two axes least parallel to a triangle find on it; ``v``: its three corners."""
    top = (1 << bits) - 1
    edge1, edge2 = v[1] - v[0], v[2] - v[0]
    flat = int(np.argmin(np.abs(np.cross(edge1, edge2) >> FRACTION)))
    low, high = np.maximum(0, (v.min(0) + HALF) >> FRACTION), np.minimum(top + 1, (v.max(0) + HALF) >> FRACTION)
    out = []
    for direction in range(3):
        if direction == flat:
            continue
        i, j = (k for k in range(3) if k != direction)
        g, h = np.meshgrid(np.arange(low[i], high[i] + 1, step), np.arange(low[j], high[j] + 1, step), indexing="ij")
        origin = np.zeros((g.size, 3), np.int64)
        origin[:, i], origin[:, j], origin[:, direction] = g.ravel() << FRACTION, h.ravel() << FRACTION, low[direction] << FRACTION
        hit, at = ray_hits(origin, v[0], edge1, edge2, direction)
        for shift in (0, thickness, -thickness):
            place = origin[hit].copy()
            place[:, direction] = at[hit] + shift
            out.append((place + HALF) >> FRACTION)
    found = np.concatenate(out) if out else np.empty((0, 3), np.int64)
    return np.unique(found[((found >= 0) & (found <= top)).all(1)], axis=0)


def rasterised(faces: DataFrame, bits: int, step: int = 1) -> DataFrame:
    """(x, y, z): the distinct voxels of all ``triangles``; ``step`` is the distance of the rays."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                found = [voxels_of(np.array([r["a"], r["b"], r["c"]]), bits, step) + (np.array([r[n] for n in NODE]) << bits) for r in batch.slice(begin, 512).to_pylist()]
                all_ = np.concatenate(found) if found else np.empty((0, 3), np.int64)
                yield pa.record_batch([pa.array(all_[:, i].astype(np.int32)) for i in range(3)], list(AXES))

    return faces.mapInArrow(fill, "x int, y int, z int").distinct()


def surface(df: DataFrame, bits: int, reach: int = 2, dropped: int = 0) -> DataFrame:
    """The triangles of the whole chain: vertices, polygons, drifted centroids and face vertices of the cloud ``df``."""
    nodes = df.select(*(F.shiftright(a, bits).alias(f"n{a}") for a in AXES)).distinct()
    each = node_vertices(edge_vertices(df, bits, reach, dropped), nodes, bits, dropped)
    shapes = staged(drifted(staged(polygons(each, bits), "polygons"), df, bits, dropped), "drifted")
    return triangles(with_faces(shapes, face_vertices(staged(face_candidates(shapes, bits), "faces"), df, bits, reach)))


def surface_within(df: DataFrame, bits: int, most: int, reach: int = 2, most_step: int = 64) -> tuple[DataFrame, int]:
    """The voxels of the surface, and the smallest distance of rays at which there are at most ``most`` of them."""
    faces = staged(surface(df, bits, reach), "triangles")
    for step in range(1, most_step + 1):
        voxels = staged(rasterised(faces, bits, step), "voxels")
        if voxels.count() <= most:
            break
    return voxels, step


def sampling_estimates(df: DataFrame, bits: int, neighbours: int = 4) -> DataFrame:
    """(nx, ny, nz, n, area, tight, spacing): three estimates of the distance of a node's points: from its width, from the two longer sides of
    its tight box, and as the mean distance to the ``neighbours`` nearest in the node, null for a lone point.

    Nodes of at most ``NODE_POINTS`` points are one row each and compared inside; those with more go by ``knn_join``.
    """
    p = nodes_of(df, bits)
    size = F.count(F.lit(1))
    crowded = staged(p.groupBy(*NODE).agg(size.alias("__n")).filter(F.col("__n") > NODE_POINTS).select(*NODE), "crowded")
    some = not crowded.isEmpty()
    code = F.shiftleft(F.shiftleft(F.col("vx").cast("bigint"), bits).bitwiseOR(F.col("vy").cast("bigint")), bits).bitwiseOR(F.col("vz").cast("bigint"))
    box = [size.alias("n"), *((F.max(f"v{a}") - F.min(f"v{a}")).alias(f"d{a}") for a in AXES)]

    @F.arrow_udf("double")
    def mean_distance(nodes: pa.Array) -> pa.Array:
        codes, ends = nodes.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(nodes).to_numpy())]
        at = np.stack([codes >> 2 * bits, codes >> bits & (1 << bits) - 1, codes & (1 << bits) - 1], 1)
        out = np.full(len(nodes), np.nan)
        for i, (low, high) in enumerate(zip(ends, ends[1:])):
            if high - low > 1:
                q = at[low:high]
                d = sum((q[:, None, j] - q[None, :, j]) ** 2 for j in range(3))
                most = min(neighbours + 1, len(q))  # a point itself is among its nearest, at distance 0
                out[i] = np.sqrt(np.partition(d, most - 1, 1)[:, :most]).sum() / (len(q) * (most - 1))
        return pa.array(out, from_pandas=True)

    small = p.join(apart(crowded), NODE, "left_anti") if some else p
    each = small.groupBy(*NODE).agg(*box, F.collect_list(code).alias("codes")).select(*NODE, "n", "dx", "dy", "dz", mean_distance("codes").alias("spacing"))
    if some:
        rows = staged(p.join(apart(crowded), NODE, "left_semi").select(*NODE, F.monotonically_increasing_id().alias("idx"), *(F.col(f"v{a}").alias(a) for a in AXES)), "crowded-rows")
        near = knn_join(rows, rows, neighbours + 1, by=tuple(NODE)).filter("t <> s")
        # a point among more equal ones than neighbours asked for is not among its own nearest: one too many is left
        order = F.row_number().over(Window.partitionBy("t").orderBy("d2", "s"))
        mean = near.withColumn("r", order).filter(F.col("r") <= neighbours).groupBy(F.col("t").alias("idx")).agg(F.avg(F.sqrt(F.col("d2").cast("double"))).alias("d"))
        spacing = rows.select(*NODE, "idx").join(apart(mean), "idx").groupBy(*NODE).agg(F.avg("d").alias("spacing"))
        boxes = rows.select(*NODE, *(F.col(a).alias(f"v{a}") for a in AXES)).groupBy(*NODE).agg(*box)
        each = each.unionByName(boxes.join(apart(spacing), NODE))
    sides = F.sort_array(F.array("dx", "dy", "dz"))
    n = F.col("n").cast("double")
    return each.select(*NODE, "n", (F.lit(float(1 << bits)) / F.sqrt(n)).alias("area"), F.sqrt(F.get(sides, F.lit(2)) * F.get(sides, F.lit(1)) / n).alias("tight"), "spacing")
