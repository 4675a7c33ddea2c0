"""Tiles, slices, runs and places: the operators that number, cut and order rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import exprs as E
from cloudloom.sources.shared import staged

AXES = E.AXES
#: Values of an integer order in a chunk of a key.
CHUNK = 1 << 18


def tile_inventory(df: DataFrame, size: int) -> DataFrame:
    """A row a tile: points, source rows, corner and size."""
    keys = [E.idiv(F.col(a), size).alias(f"t{a}") for a in AXES]
    aggs = [F.count(F.lit(1)).alias("n_pts"), F.sum("n_src").alias("n_src")]
    return df.groupBy(*keys).agg(*aggs, *(F.min(a).alias(f"min_{a}") for a in AXES), *((F.max(a) - F.min(a) + 1).alias(f"size_{a}") for a in AXES))


def tile_counts(df: DataFrame, size: int) -> DataFrame:
    """(tile_id, n) of each tile, numbered in Morton order: rows become counts first, and only the tiles are ranked."""
    counts = staged(df.groupBy(E.morton(*(E.idiv(F.col(a), size) for a in AXES)).alias("__m")).agg(F.count(F.lit(1)).alias("n")), "tiles")
    return sorted_place(counts, ["__m"]).select(F.col("place").alias("tile_id"), "n")


def _numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row's key among the distinct keys, in their order.

    The distinct keys are ranked by ``sorted_place``, so no task sees all of them.
    """
    ranked = sorted_place(df.select(*keys).distinct(), keys).withColumnRenamed("place", name)
    return df.join(ranked, keys)


def morton_tiles(df: DataFrame, size: int) -> DataFrame:
    """Rows with the dense number of their tile in Morton order."""
    keyed = df.withColumn("__m", E.morton(*(E.idiv(F.col(a), size) for a in AXES)))
    return _numbered(keyed, ["__m"], "tile_id").drop("__m")


def octree_slices(df: DataFrame, bits: int) -> DataFrame:
    """Rows with the dense number of their octree cell in (x, y, z) order."""
    keyed = df.withColumns({f"__{a}": F.shiftright(F.col(a), bits) for a in AXES})
    return _numbered(keyed, [f"__{a}" for a in AXES], "slice_id").drop(*(f"__{a}" for a in AXES))


def sorted_place(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0, by a range sort.

    The range-sorted rows are written once; places are the row's number in its part plus the sizes of the parts before, so
    nothing but a row for each part is gathered.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = staged(cut, "sorted").withColumn("__part", F.shiftright("__at", 33))
    sizes = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    placed = held.join(F.broadcast(starts), "__part")
    return placed.withColumn("place", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__start")


def place_within(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with the place of each row in ``order`` among those of equal ``keys``, from 0: a range sort over keys and order, less where its key begins, so a key of many rows is many tasks' work."""
    placed = sorted_place(df, [*keys, *order])
    begins = placed.groupBy(*keys).agg(F.min("place").alias("__begin"))
    return placed.join(begins, keys).withColumn("place", F.col("place") - F.col("__begin")).drop("__begin")


def laser_order(df: DataFrame, origin: tuple[int, int] = (0, 0), angle: str = "laserangle") -> DataFrame:
    """``df`` with its ``place`` by laser angle, or, where it has no such column, by azimuth around ``origin`` in 1/1000, radius and slope; ties by idx."""
    if angle in df.columns:
        return sorted_place(df, [angle, "idx"])
    x, y = ((F.col(a) - o).cast("double") for a, o in zip(AXES[:2], origin, strict=True))
    r = F.sqrt(x * x + y * y)
    keyed = df.withColumns({"__phi": F.round(F.atan2(y, x) * 1000), "__r": r, "__slope": F.when(r > 0, F.col("z") / r).otherwise(0.0)})
    return sorted_place(keyed, ["__phi", "__r", "__slope", "idx"]).drop("__phi", "__r", "__slope")


def before_in_chunks(df: DataFrame, keys: list[str], order: str, columns: list[str], depth: int = 1, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``before``: the (order, columns) of up to ``depth`` rows before each row of equal ``keys``, the nearest first.

    Rows go to windows of a key and a run of ``chunk`` values of ``order`` (an integer), so few keys of many rows are many tasks' work. The last rows of each
    chunk, ``depth`` at most, are carried to the chunks behind it by a window over a row for each chunk.
    """
    rows = df.withColumn("__c", F.floor(F.col(order) / chunk))
    w = Window.partitionBy(*keys, "__c").orderBy(order)
    own = F.struct(order, *columns)
    rows = rows.withColumns({"__r": F.row_number().over(w)} | {f"__l{i}": F.lag(own, i).over(w) for i in range(1, depth + 1)})
    last = df.withColumn("__c", F.floor(F.col(order) / chunk)).withColumn("__b", F.row_number().over(Window.partitionBy(*keys, "__c").orderBy(F.col(order).desc()))).filter(F.col("__b") <= depth)
    ends = last.groupBy(*keys, "__c").agg(F.sort_array(F.collect_list(own), asc=False).alias("__ends"))
    chunks_ = Window.partitionBy(*keys).orderBy("__c")
    carried = ends.select(*keys, "__c", F.slice(F.flatten(F.array_compact(F.array(*(F.lag("__ends", i).over(chunks_) for i in range(1, depth + 1))))), 1, depth).alias("__carried"))
    within = F.array_compact(F.array(*(F.col(f"__l{i}") for i in range(1, depth + 1))))
    both = rows.join(carried, [*keys, "__c"])
    return both.select(*df.columns, F.slice(F.concat(within, "__carried"), 1, depth).alias("before"))


def adjacent_unique(df: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """Rows whose value differs from the row before them, which is not DISTINCT."""
    before = F.get("before", F.lit(0))[value]
    return before_in_chunks(df, list(keys), order, [value]).filter(before.isNull() | (before != F.col(value))).drop("before")


def runs(df: DataFrame, value: str, order: str, *keys: str, chunk: int = CHUNK) -> DataFrame:
    """A row for each run of equal values: its first ``order``, value and length. Runs are numbered within chunks of a key and moved by the runs of the chunks before."""
    seen = before_in_chunks(df.select(*keys, order, value), list(keys), order, [value], chunk=chunk)
    before = F.get("before", F.lit(0))[value]
    begins = seen.select(*keys, order, value, F.coalesce((before != F.col(value)).cast("int"), F.lit(1)).alias("__b"), F.floor(F.col(order) / chunk).alias("__c"))
    sizes = begins.groupBy(*keys, "__c").agg(F.sum("__b").alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    starts = sizes.select(*keys, "__c", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__start"))
    w = Window.partitionBy(*keys, "__c").orderBy(order)
    numbered = begins.withColumn("__in", F.sum("__b").over(w)).join(starts, [*keys, "__c"]).withColumn("__run", F.col("__start") + F.col("__in"))
    return numbered.groupBy(*keys, "__run").agg(F.min(order).alias(order), F.first(value).alias(value), F.count(F.lit(1)).alias("n")).drop("__run")


def unwrap_counter(df: DataFrame, order: str, lsb: str, modulus: int) -> DataFrame:
    """Counters whose low bits are known, each the nearest to the one before; a half turn counts upward. A row a frame."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    gap = F.col(lsb) - F.lag(lsb).over(w)
    half = modulus // 2
    step = F.when(gap <= -half, gap + modulus).when(gap > half, gap - modulus).otherwise(gap)
    stepped = df.withColumn("__s", F.coalesce(step, F.lit(0)))
    return stepped.select(order, lsb, (F.first(lsb).over(w) + F.sum("__s").over(w)).cast("bigint").alias("counter"))


def sampled_distance(df: DataFrame, period: int, reach: int, share: float) -> DataFrame:
    """The ``share`` order statistic of the distance from every ``period``-th row to its nearest within -+ ``reach`` rows.

    A range join on the row number, by blocks of rows so that it is an equi-join.
    """
    width = 2 * reach
    own = df.filter(F.col("idx") % period == 0).select("idx", *AXES)
    at = own.select(F.col("idx").alias("i"), *(F.col(a).alias(f"q{a}") for a in AXES), F.explode(F.array(*(F.floor((F.col("idx") + o) / width) for o in (-reach, reach)))).alias("b")).distinct()
    rows = df.select("idx", *AXES, F.floor(F.col("idx") / width).alias("b"))
    near = at.join(rows, "b").filter((F.abs(F.col("idx") - F.col("i")) <= reach) & (F.col("idx") != F.col("i")))
    d2 = near.groupBy("i").agg(F.min(E.distance2(*((F.col(a), F.col(f"q{a}")) for a in AXES))).alias("dist2"))
    placed = sorted_place(d2, ["dist2", "i"])
    n = placed.agg(F.count(F.lit(1)).alias("c"))
    return placed.crossJoin(F.broadcast(n)).filter(F.col("place") == F.floor(F.col("c") * share)).select("dist2")  # one row


def order_statistic(df: DataFrame, key: str, value: str, numerator: int, denominator: int, name: str) -> DataFrame:
    """The value at place floor(n * numerator / denominator) of each key's sorted values, by counts of values: no group is sorted whole."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(key).orderBy(value)
    total = F.sum("__n").over(Window.partitionBy(key))
    ranked = counts.select(key, value, F.sum("__n").over(w).alias("__to"), E.idiv(total * numerator, denominator).alias("__at"))
    return ranked.filter(F.col("__to") > F.col("__at")).groupBy(key).agg(F.min(value).alias(name))


def axes_by_extent(df: DataFrame) -> DataFrame:
    """The longest and the shortest axis; the first wins a tie."""
    e = df.agg(*((F.max(a) - F.min(a)).alias(a) for a in AXES))
    x, y, z = (F.col(a) for a in AXES)
    return e.select(F.when((x >= y) & (x >= z), "x").when(y >= z, "y").otherwise("z").alias("longest"), F.when((x <= y) & (x <= z), "x").when(y <= z, "y").otherwise("z").alias("shortest"))


def over_limit(df: DataFrame, key: str, most: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("over_limit", F.col("n") > most)


def check_limit(df: DataFrame, key: str, most: int) -> DataFrame:
    """``over_limit`` that fails the job where a slice is over the limit."""
    return over_limit(df, key, most).withColumn("n", F.when(F.col("over_limit"), F.raise_error(F.lit(f"a slice has more than {most} points"))).otherwise(F.col("n")))


def blocks_with_halo(df: DataFrame, axes: dict[str, tuple[int, int, str]]) -> DataFrame:
    """(idx, block) of every block that a row is in or within the halo of; ``axes``: column -> (width, halo, name)."""
    out = df.select("idx", *axes)
    for a, (width, halo, name) in axes.items():
        out = out.withColumn(name, F.explode(F.array_distinct(F.array(*(F.floor((F.col(a) + o) / width) for o in (-halo, 0, halo))))))
    return out.select("idx", *(name for _, _, name in axes.values())).distinct()


def uniform_slices(df: DataFrame, most: int, most_rounds: int = 20) -> DataFrame:
    """Rows with ``slice_id`` along the longest axis; the number of slices doubles until over half of them hold at most ``most`` points."""
    longest = axes_by_extent(df).first()["longest"]
    low, high, n = df.agg(F.min(longest), F.max(longest), F.count(F.lit(1))).first()
    slices = max(1, -(-n // most))
    for _ in range(most_rounds):
        width = max(1, -(-(high - low + 1) // slices))
        keyed = df.withColumn("slice_id", F.least(F.floor((F.col(longest) - low) / width), F.lit(slices - 1)).cast("int"))
        full = over_limit(keyed, "slice_id", most).agg(F.avg(F.col("over_limit").cast("int"))).first()[0]
        if full < 0.5 or width == 1:
            return keyed
        slices *= 2
    return keyed


def split_slices(df: DataFrame, key: str, axis: str | None, most: int) -> DataFrame:
    """Slices over ``most`` points cut into even runs of their order along ``axis``, or the slice's own longest axis for None (ties by idx): ``part`` numbers them."""
    extent = [(F.max(a) - F.min(a)).alias(f"__e{a}") for a in AXES] if axis is None else []
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *extent)
    rows = df.join(sizes, key)
    if axis is None:
        ex, ey, ez = (F.col(f"__e{a}") for a in AXES)
        rows = rows.withColumn("__v", F.when((ex >= ey) & (ex >= ez), F.col("x")).when(ey >= ez, F.col("y")).otherwise(F.col("z")))
    w = Window.partitionBy(key).orderBy("__v" if axis is None else axis, "idx")
    ranked = rows.withColumn("__r", F.row_number().over(w) - 1)
    pieces = F.ceil(F.col("__n") / most)
    return ranked.withColumn("part", F.floor(F.col("__r") * pieces / F.col("__n")).cast("int")).select(*df.columns, "part")


def merged_cells(sizes: DataFrame, most: int) -> DataFrame:
    """(tile, gx, gy, gz, head) for a table (tile, gx, gy, gz, n) of the cells of a grid in each tile: neighbours joined while together they have fewer than ``most`` points.

    The smallest group is taken first, ties by its first cell; it joins the group that holds one of the six cells around its mean cell, the
    one whose cell is nearest to its mean, the last of equal ones; the result goes on as a group of its new size. A group that finds no partner is done.
    ``head`` is its first cell. A tile's cells are a small table and one task's work, as each step depends on the one before.
    """

    def run(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by([("gx", "ascending"), ("gy", "ascending"), ("gz", "ascending")])
        cells = list(zip(*(t[c].to_pylist() for c in ("gx", "gy", "gz")), strict=True))
        groups = {c: ([c], n) for c, n in zip(cells, t["n"].to_pylist(), strict=True)}
        owner = {c: c for c in cells}
        waiting = [(n, c) for c, (_, n) in groups.items()]
        heapq.heapify(waiting)
        while waiting:
            n, head = heapq.heappop(waiting)
            if head not in groups or groups[head][1] != n:
                continue
            own = groups[head][0]
            mean = tuple(sum(c[i] for c in own) / len(own) for i in range(3))
            at, best = tuple(int(m) for m in mean), None
            for axis in range(3):
                for step in (-1, 1):
                    near = tuple(v + step * (i == axis) for i, v in enumerate(at))
                    other = owner.get(near)
                    if other is None or other == head or groups[other][1] + n >= most:
                        continue
                    away = sum((a - b) ** 2 for a, b in zip(mean, near, strict=True))
                    if best is None or away <= best[0]:
                        best = (away, other)
            if best is None:
                continue
            joined = own + groups[best[1]][0]
            total, first = n + groups[best[1]][1], min(joined)
            del groups[head], groups[best[1]]
            groups[first] = (joined, total)
            owner.update(dict.fromkeys(joined, first))
            heapq.heappush(waiting, (total, first))
        order = {h: i for i, h in enumerate(sorted(groups))}
        yield pa.record_batch([pa.array([keys[0].as_py()] * len(cells), pa.int64()), *(pa.array([c[i] for c in cells], pa.int64()) for i in range(3)), pa.array([order[owner[c]] for c in cells], pa.int64())], ["tile", "gx", "gy", "gz", "head"])

    rows = sizes.select(*(F.col(c).cast("long").alias(c) for c in ("tile", "gx", "gy", "gz", "n")))
    return rows.groupBy("tile").applyInArrow(run, "tile long, gx long, gy long, gz long, head long")


def refined_slices(df: DataFrame, size: tuple[int, int, int], most: int, tile: str | None = None) -> DataFrame:
    """``df`` (idx, x, y, z, and ``tile``) with ``slice_id``: cells of a grid, those over ``most`` points split along their longest axis, the others joined with small neighbours, and all numbered anew within their tile, joined ones first."""
    cell = [F.floor(F.col(a) / s).cast("long").alias(f"g{a}") for a, s in zip(AXES, size, strict=True)]
    g = ["tile", "gx", "gy", "gz"]
    rows = df.select("*", (F.col(tile) if tile else F.lit(0)).cast("long").alias("tile"), *cell) if tile != "tile" else df.select(*df.columns, *cell)
    sizes = staged(rows.groupBy(*g).agg(F.count(F.lit(1)).alias("n")), "cells")
    joined = merged_cells(sizes.filter(F.col("n") <= most), most)
    heads = joined.groupBy("tile").agg((F.max("head") + 1).alias("__first"))
    # split cells come behind the joined ones, in the order of their cells
    w = Window.partitionBy("tile").orderBy("gx", "gy", "gz").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell that is too large
    large = sizes.filter(F.col("n") > most).withColumn("__pieces", F.ceil(F.col("n") / most))
    large = large.withColumn("__before", F.coalesce(F.sum("__pieces").over(w), F.lit(0))).join(heads, "tile", "left").select(*g, (F.coalesce("__first", F.lit(0)) + F.col("__before")).alias("__base"))
    small_rows = rows.join(joined, g).select(*df.columns, F.col("head").cast("long").alias("slice_id"))
    cut = split_slices(rows.join(large, g).withColumn("__cell", F.struct(*g)), "__cell", None, most)
    return small_rows.unionByName(cut.select(*df.columns, (F.col("__base") + F.col("part")).cast("long").alias("slice_id")))


def least_origin(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The smaller origin of two tables (key, min_x, min_y, min_z), axis by axis."""
    other = b.select(key, *(F.col(f"min_{x}").alias(f"__{x}") for x in AXES))
    return a.join(other, key).select(key, *(F.least(f"min_{x}", f"__{x}").alias(f"min_{x}") for x in AXES))


def box_hierarchy(df: DataFrame, bucket: int = 32, levels: int = 3) -> DataFrame:
    """(level, bucket, n, min_x .. max_z): boxes of ``bucket`` rows in Morton order, of ``bucket`` such boxes, and so on, each level rolled up from the one below."""
    placed = sorted_place(df.select("idx", *AXES, E.morton(*AXES).alias("__m")), ["__m", "idx"])
    ends = [(f, n, a) for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))]
    here = placed.groupBy(F.floor(F.col("place") / bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{n}_{a}") for f, n, a in ends))
    out = None
    for level in range(levels):
        if level:
            here = here.groupBy(F.floor(F.col("bucket") / bucket).alias("bucket")).agg(F.sum("n").alias("n"), *(f(f"{n}_{a}").alias(f"{n}_{a}") for f, n, a in ends))
        here = staged(here, "boxes")
        rows = here.withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return out


def occupied(df: DataFrame, column: str, slices: int) -> DataFrame:
    """(column, n) of the slices 0 to ``slices`` - 1 that have points: those that a table of all slices would show as empty are dropped."""
    every = df.sparkSession.range(slices).select(F.col("id").cast("int").alias(column))
    return every.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").filter("n > 0")
