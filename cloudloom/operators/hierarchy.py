"""Octree levels and the region-adaptive hierarchical transform."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.operators.joins import apart
from cloudloom.sources.shared import staged

AXES = E.AXES
#: Levels between two that are written, so that plans don't grow with the square of the depth.
STAGED_LEVELS = 3
#: Pairs of a 2x2x2 block that each step of the transform joins, z then y then x.
STEPS = (((0, 1), (2, 3), (4, 5), (6, 7)), ((0, 2), (4, 6), (1, 3), (5, 7)), ((0, 4), (1, 5), (2, 6), (3, 7)))


def octree(df: DataFrame, depth: int) -> DataFrame:
    """(level, nx, ny, nz, n, occupancy) of every node of every level, from one pass: each level rolls up the one below.

    Every third level is staged, so that the plan of a level holds at most three aggregates whatever the depth.
    """
    nodes = df.groupBy(*(F.col(a).alias(f"n{a}") for a in AXES)).agg(F.count(F.lit(1)).alias("n")).select("*", F.lit(0).alias("occupancy"), F.lit(0).alias("level"))
    out, below = None, nodes
    for level in range(1, depth + 1):
        child = 4 * F.col("nx").bitwiseAND(1) + 2 * F.col("ny").bitwiseAND(1) + F.col("nz").bitwiseAND(1)
        up = below.select(*(F.shiftright(f"n{a}", 1).alias(f"n{a}") for a in AXES), "n", child.alias("child"))
        below = up.groupBy("nx", "ny", "nz").agg(F.sum("n").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("child"))).alias("occupancy")).withColumn("level", F.lit(level))
        if level % STAGED_LEVELS == 0 and level < depth:
            below = staged(below, "octree")
        out = below if out is None else out.unionByName(below)
    return out.select("level", "nx", "ny", "nz", "n", "occupancy")


def decode_octree(nodes: DataFrame, depth: int, stop: int = 0) -> DataFrame:
    """Positions of the leaves at level ``stop``, from the root's occupancy down: each level is a join of the last one's children with their nodes."""
    at = nodes.filter(F.col("level") == depth).select("nx", "ny", "nz", "occupancy")
    for level in range(depth, stop, -1):
        bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", F.col("occupancy"), i).bitwiseAND(1) == 1)
        below = at.select("nx", "ny", "nz", F.explode(bits).alias("c")).select((F.col("nx") * 2 + F.shiftright("c", 2)).alias("nx"), (F.col("ny") * 2 + F.shiftright("c", 1).bitwiseAND(1)).alias("ny"), (F.col("nz") * 2 + F.col("c").bitwiseAND(1)).alias("nz"))
        at = below.join(nodes.filter(F.col("level") == level - 1).select("nx", "ny", "nz", "occupancy"), ["nx", "ny", "nz"]) if level - 1 > 0 else below
    return at.select(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"))


def cell_centres(df: DataFrame, bits: int) -> DataFrame:
    """Centres of the occupied cells of 2^bits, with their points."""
    half = (1 << bits) >> 1
    return df.groupBy(*((F.col(a).bitwiseAND(~((1 << bits) - 1)) + half).alias(a) for a in AXES)).agg(F.count(F.lit(1)).alias("n"))


def split_schedule(bits: tuple[int, int, int], max_first: int = 0, min_size: int = 0) -> list[tuple[bool, bool, bool]]:
    """Which axes each level of a non-cubic tree splits: the longest ones first while ``max_first`` such splits remain, then all that are over ``min_size``."""
    left, out = list(bits), []
    while max(left) > 0:
        longest, shortest = max(left), min(left)
        uneven = longest > shortest and len(out) < max_first or shortest <= min_size < longest
        split = tuple((v == longest if uneven else True) and v > 0 for v in left)
        left = [v - s for v, s in zip(left, split, strict=True)]
        out.append(split)
    return out


def raht_level(df: DataFrame, level: int, key: str = "morton") -> DataFrame:
    """One roll-up: nodes equal above ``level`` bits joined, weights and sums added."""
    return df.groupBy(F.shiftright(key, level).alias(key)).agg(F.sum("weight").alias("weight"), F.sum("value").alias("value"))


def raht_blocks(df: DataFrame, levels: Sequence[int], value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, level, node, w0..w7, s0..s7): weights and sums of the eight children of every node at each level (in bits, multiples of 3).

    Levels roll up one from the other, so each is an aggregate of a smaller table.
    """
    base = df.groupBy(*by, E.morton(*AXES).alias("m")).agg(F.count(F.lit(1)).alias("w"), F.sum(F.col(value).cast("bigint")).alias("s"))
    out, below, at = None, base, 0
    child, none = F.col("m").bitwiseAND(7), F.lit(0)
    sums = [F.coalesce(F.sum(F.when(child == i, F.col(c))), none).alias(f"{c}{i}") for c in "ws" for i in range(8)]
    for i, level in enumerate(sorted(levels)):
        if level > at:
            below, at = below.groupBy(*by, F.shiftright("m", level - at).alias("m")).agg(F.sum("w").alias("w"), F.sum("s").alias("s")), level
        if i % STAGED_LEVELS == 0:
            below = staged(below, "raht-level")
        block = below.groupBy(*by, F.shiftright("m", 3).alias("node")).agg(*sums).withColumn("level", F.lit(level))
        out = block if out is None else out.unionByName(block)
    return out


#: Columns that one projection sets; lists of them follow each other.
Columns = dict[str, Column]


def _with(t: DataFrame, steps: Sequence[Columns]) -> DataFrame:
    for new in steps:
        t = t.withColumns(new)
    return t


def _butterflies(*names: str) -> list[Columns]:
    """The 12 weighted butterflies of a block with weights u0..u7, for coefficients of each of ``names``, null where a child is absent.

    A pair with one side empty moves the other to the low place.
    """
    out = []
    for step in STEPS:
        new = {}
        for i, j in step:
            wi, wj = F.col(f"u{i}"), F.col(f"u{j}")
            both, p, q = (wi > 0) & (wj > 0), F.sqrt(wi / (wi + wj)), F.sqrt(wj / (wi + wj))
            for n in names:
                a, b = F.col(f"{n}{i}"), F.col(f"{n}{j}")
                new |= {f"{n}{i}": F.when(both, p * a + q * b).otherwise(F.coalesce(a, b)), f"{n}{j}": F.when(both, p * b - q * a)}
            new |= {f"u{i}": wi + wj, f"u{j}": F.when(both, wi + wj).otherwise(0.0)}
        out.append(new)
    return out


def _start(**sums: str) -> Columns:
    """Weights u0..u7 and, for each name, coefficients of the sums of another."""
    return {f"u{i}": F.col(f"w{i}").cast("double") for i in range(8)} | {f"{n}{i}": F.when(F.col(f"w{i}") > 0, F.col(f"{s}{i}") / F.sqrt(f"w{i}")) for n, s in sums.items() for i in range(8)}


def transform_blocks(blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, level, node, w, c0..c7): the 12 weighted butterflies of every block. c0 is its DC, ``w`` its weight, null where a coefficient is absent.

    Projections follow each other, and generated code runs them in one stage.
    """
    t = _with(blocks, [_start(c="s"), *_butterflies("c")])
    return t.select(*by, "level", "node", F.col("u0").alias("w"), *(f"c{i}" for i in range(8)))


def raht(df: DataFrame, value: str, depth: int) -> DataFrame:
    """The whole forward transform without prediction: AC coefficients of every block of every level, and the root's DC."""
    return raht_of(raht_blocks(df, [3 * k for k in range(depth)], value), depth)


def raht_of(blocks: DataFrame, depth: int) -> DataFrame:
    """The coefficients of ``raht_blocks``."""
    blocks = transform_blocks(blocks)
    each = blocks.select("level", "node", "w", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col(f"c{i}").alias("coefficient")) for i in range(8)))).alias("e"))
    rows = each.select("level", "node", "w", "e.*").filter(F.col("coefficient").isNotNull())
    return rows.filter((F.col("band") > 0) | (F.col("level") == 3 * (depth - 1)))


def _undone() -> list[Columns]:
    """The butterflies of blocks (w0..w7, c0..c7) undone, a child's coefficient at its place."""
    out = [{f"u0_{i}": F.col(f"w{i}").cast("double") for i in range(8)}]
    for k_step, step in enumerate(STEPS[:-1]):
        u = lambda i, k_step=k_step: F.col(f"u{k_step}_{i}")
        out.append({f"u{k_step + 1}_{i}": u(i) + u(j) for i, j in step} | {f"u{k_step + 1}_{j}": F.when((u(i) > 0) & (u(j) > 0), u(i) + u(j)).otherwise(0.0) for i, j in step})
    for k_step in range(len(STEPS) - 1, -1, -1):
        new = {}
        for i, j in STEPS[k_step]:
            wi, wj, a, b = F.col(f"u{k_step}_{i}"), F.col(f"u{k_step}_{j}"), F.col(f"c{i}"), F.col(f"c{j}")
            both = (wi > 0) & (wj > 0)
            p, q = F.sqrt(wi / (wi + wj)), F.sqrt(wj / (wi + wj))
            new |= {f"c{i}": F.when(both, p * a - q * b).otherwise(F.when(wi > 0, a)), f"c{j}": F.when(both, q * a + p * b).otherwise(F.when(wj > 0, a))}
        out.append(new)
    return out


def _children(t: DataFrame, steps: Sequence[Columns], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, w, c0) of the children of blocks (by, node, w0..w7, c0..c7), by ``_undone``."""
    children = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"w{i}").alias("w"), F.col(f"c{i}").alias("c")) for i in range(8)))).alias("e")
    return _with(t, steps).select(*by, "node", children).filter("e.w > 0").select(*by, (F.col("node") * 8 + F.col("e.i")).alias("node"), F.col("e.w").alias("w"), F.col("e.c").alias("c0"))


def inverse_raht(blocks: DataFrame, coefficients: DataFrame, depth: int) -> DataFrame:
    """(m, w, s): weights and sums at every point place again, from the root's DC and the AC coefficients, level by level downward."""
    wide = coefficients.groupBy("level", "node").agg(*(F.max(F.when(F.col("band") == i, F.col("coefficient"))).alias(f"c{i}") for i in range(8)))
    dc, undone = None, _undone()
    for k in range(depth - 1, -1, -1):
        t = blocks.filter(F.col("level") == 3 * k).join(wide.filter(F.col("level") == 3 * k).drop("level"), "node", "left")
        if dc is not None:
            t = t.drop("c0").join(dc, "node")
        below = _children(t, undone)
        dc = staged(below.select("node", "c0") if k else below, "unraht")
    return dc.select(F.col("node").alias("m"), "w", (F.col("c0") * F.sqrt("w")).alias("s"))


def _looks() -> list[tuple[int, int, int, int]]:
    """(address steps forward and back, weight, children that it counts for) of a node itself, its 6 face and its 12 edge neighbours."""
    out = []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            for dz in (-1, 0, 1):
                d = (dx, dy, dz)
                apart = sum(map(abs, d))
                if apart < 3:
                    forward, back = (sum(1 << 2 - i for i, v in enumerate(d) if v == sign) for sign in (1, -1))
                    near = sum(1 << c for c in range(8) if all(not v or (c >> 2 - i & 1) == (v > 0) for i, v in enumerate(d)))
                    out.append((forward, back, (4, 2, 1)[apart], near))
    return out


def upsampled(parents: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, v, p0..p7): values predicted for the eight children of each of ``parents`` (by, node, v), node an address.

    A child gets the mean of its parent (weight 4) and of the parent's neighbours across the faces (2) and edges (1) it touches, but for those whose
    value is a fifth of the parent's or less, or two and a half times it or more. Every node sends its value to the 19 nodes around, one equi-join and one sum.
    """
    looks = F.array(*(F.struct(F.lit(f).cast("bigint").alias("f"), F.lit(b).cast("bigint").alias("b"), F.lit(w).alias("weight"), F.lit(m).alias("mask")) for f, b, w, m in _looks()))
    sent = parents.select(*by, "node", "v", F.explode(looks).alias("l"))
    # a node sees its neighbour at a step, so it is found by the step back
    sent = sent.select(*by, E.morton_subtract(E.morton_add(F.col("node"), F.col("l.b")), F.col("l.f")).alias("node"), F.col("v").alias("nv"), F.col("l.weight").alias("weight"), F.col("l.mask").alias("mask"))
    met = sent.join(apart(parents), [*by, "node"]).filter((F.col("mask") == 255) | ((10 * F.col("nv") > 2 * F.col("v")) & (10 * F.col("nv") < 25 * F.col("v"))))
    on = lambda i: F.col("mask").bitwiseAND(1 << i) > 0
    return met.groupBy(*by, "node").agg(F.max("v").alias("v"), *((F.sum(F.when(on(i), F.col("weight") * F.col("nv"))) / F.sum(F.when(on(i), F.col("weight")))).alias(f"p{i}") for i in range(8)))


def raht_predicted(df: DataFrame, value: str, depth: int, qp: int, predict: bool = True, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """((by, level, node, band, level_q), (by, m, w, v)): quantised coefficients of the transform with prediction, and what is reconstructed of each place's mean.

    From the root down, the children's values are predicted from the reconstructed parents around (``upsampled``), both blocks are transformed, the
    differences of their AC coefficients are quantised, and the block is rebuilt from the parent's value and the rebuilt coefficients. A level is a join of
    the parents with those around and one with its blocks; both transforms run over the same row, and their columns are made once for all levels.
    ``by`` names keys whose clouds are coded apart, in the same plans.
    """
    blocks = staged(raht_blocks(df, [3 * k for k in range(depth)], value, by), "blocks")
    scaled = lambda c: E.attribute_quantised(F.round(c * 256).cast("bigint"), qp)
    step = E.ATTRIBUTE_STEPS[max(qp, 4) % 6] * (1 << max(qp, 4) // 6) / 256.0
    keys, ac = [*by, "node"], range(1, 8)
    guessed = {f"e{i}": F.col(f"p{i}") * F.col(f"w{i}") for i in range(8)}
    forward = [guessed, _start(c="s", g="e"), *_butterflies("c", "g")] if predict else [_start(c="s"), *_butterflies("c"), {f"g{i}": F.lit(0.0) for i in ac}]
    kept = [*keys, F.col("u0").alias("w"), "v", *(f"w{i}" for i in range(8)), *(f"g{i}" for i in ac), *(scaled(F.col(f"c{i}") - F.coalesce(F.col(f"g{i}"), F.lit(0.0))).alias(f"q{i}") for i in ac)]
    bands = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col(f"q{i}").alias("q")) for i in ac))).alias("e")
    rebuilt = {f"c{i}": F.when(F.col(f"q{i}").isNotNull(), F.coalesce(F.col(f"g{i}"), F.lit(0.0)) + F.col(f"q{i}") * step) for i in ac} | {"c0": F.col("v") * F.sqrt("w")}
    back, value_of = [rebuilt, *_undone()], (F.col("c0") / F.sqrt("w")).alias("v")
    coded, known = None, None
    for k in range(depth - 1, -1, -1):
        here = blocks.filter(F.col("level") == 3 * k)
        if known is None:
            root = transform_blocks(here, by)
            coded = root.select(*by, F.lit(3 * k).alias("level"), "node", F.lit(0).alias("band"), scaled(F.col("c0")).alias("q"))
            known = staged(root.select(*keys, (scaled(F.col("c0")) * step / F.sqrt("w")).alias("v")), "rebuilt")
        around = upsampled(known, by) if predict else known
        rows = staged(_with(here.drop("level").join(apart(around), keys), forward).select(*kept), "coded")
        coded = coded.unionByName(rows.select(*keys, bands).select(*by, F.lit(3 * k).alias("level"), "node", "e.*").filter("q is not null"))
        leaves = staged(_children(rows, back, by).select(*keys, "w", value_of), "rebuilt")
        known = leaves.select(*keys, "v")
    return coded, leaves.select(*by, F.col("node").alias("m"), "w", "v")


def raht_attributes(df: DataFrame, attributes: list[str], depth: int, qp: int, high: int = 255) -> DataFrame:
    """(m, attributes): several attributes through ``raht_predicted``, each rounded and kept within 0 and ``high``, a row for each place.

    They go through it as rows, so plans are those of one attribute however many there are.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("attribute"), F.col(a).cast("bigint").alias("value")) for i, a in enumerate(attributes)))).alias("e")
    v = raht_predicted(df.select(*AXES, each).select(*AXES, "e.*"), "value", depth, qp, by=("attribute",))[1]
    whole = E.clip(F.round("v"), 0, high).cast("int")
    return v.groupBy("m").agg(*(F.max(F.when(F.col("attribute") == i, whole)).alias(a) for i, a in enumerate(attributes)))


def zeroed(coefficients: DataFrame, key: str, qp: int) -> DataFrame:
    """(key, place, q): levels of ``coefficients`` (key, place, coefficient) in order of place, those dropped that cost more bits than they save error.

    The cost of a level depends on the run of zeros before it, so each key (a slice) is one task's stream; the rate is in bits, the
    error in squares of coefficients, and a bit is worth 25 squared steps.
    """

    def run(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by("place")
        c, q = np.round(t["c"].to_numpy()).astype(np.int64), t["q"].to_numpy().copy()
        zeros = 0
        for i in range(len(q)):
            if 0 < abs(q[i]) < 3 and int(c[i]) ** 2 << 26 < step * step * 25 * zero_rate(zeros, abs(int(q[i]))):
                q[i] = 0
            zeros = zeros + 1 if q[i] == 0 else 0
        yield pa.record_batch([pa.array([keys[0].as_py()] * len(q), pa.string()), t["place"].combine_chunks(), pa.array(q)], ["key", "place", "q"])

    step = E.ATTRIBUTE_STEPS[max(qp, 4) % 6] << max(qp, 4) // 6
    level = E.attribute_quantised(F.round(F.col("coefficient")).cast("bigint") * 256, qp)
    rows = coefficients.select(F.col(key).cast("string").alias("key"), F.col("place").cast("long").alias("place"), F.col("coefficient").cast("double").alias("c"), level.alias("q"))
    return rows.groupBy("key").applyInArrow(run, "key string, place long, q long")


#: Bits of a run of up to ten zeros.
RUN_BITS = (1, 2, 3, 5, 5, 7, 7, 9, 9, 11, 11)


def zero_rate(zeros: int, level: int) -> int:
    """Bits of a level behind ``zeros`` zeros: of the run, in growing groups from eleven on, and the binary logarithm of one more than the level."""
    rate = RUN_BITS[min(zeros, 10)]
    if zeros > 10:
        rate += 2 * (zeros - 10).bit_length() + 1
    return rate + (round(256 * math.log2(1 + min(level, 15))) + 128 >> 8)


def joined_levels(df: DataFrame, value: str, levels: Sequence[int], frame: str = "frame") -> DataFrame:
    """(frame, level, node, w, v, ref_w, ref_v): nodes that a frame shares with the one before it, at each level, with the weights and sums of both."""
    rolled = df.groupBy(frame, F.shiftright(E.morton(*AXES), min(levels)).alias("m")).agg(F.count(F.lit(1)).alias("w"), F.sum(value).alias("v"))
    each = rolled.select(frame, "m", "w", "v", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    nodes = each.groupBy(frame, "level", F.expr(f"shiftright(m, level - {min(levels)})").alias("node")).agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    before = nodes.select((F.col(frame) + 1).alias(frame), "level", "node", F.col("w").alias("ref_w"), F.col("v").alias("ref_v"))
    return nodes.join(before, [frame, "level", "node"])


def sibling_patterns(nodes: DataFrame) -> DataFrame:
    """(level, nx, ny, nz, child, pattern): for each child of nodes with an occupancy byte, which of its six face neighbours are siblings there: two bits an axis, x lowest."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", F.col("occupancy"), i).bitwiseAND(1) == 1)
    each = nodes.select("level", "nx", "ny", "nz", "occupancy", F.explode(bits).alias("child"))
    pattern = None
    for axis, bit in enumerate((4, 2, 1)):
        there = F.call_function("shiftright", F.col("occupancy"), F.col("child").bitwiseXOR(F.lit(bit))).bitwiseAND(1)
        own = F.shiftright("child", 2 - axis).bitwiseAND(1)
        place = 2 * axis + (own if axis == 0 else 1 - own)
        part = F.call_function("shiftleft", there, place)
        pattern = part if pattern is None else pattern.bitwiseOR(part)
    return each.select("level", "nx", "ny", "nz", "child", pattern.cast("int").alias("pattern"))
