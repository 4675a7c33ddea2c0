"""Spatial, nearest-value, box and as-of joins."""

from __future__ import annotations

import math
from functools import reduce as fold

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from cloudloom.functions import exprs as E
from cloudloom.sources.shared import staged

AXES = E.AXES
#: Places wanted in a leaf of the nearest join, most leaves (then they grow), sampled rows for each leaf, rows from which a sample is taken, places of a task, and pairs at a time in a task.
LEAF_ROWS, MOST_LEAVES, LEAF_SAMPLES, SAMPLED_FROM, TASK_ROWS, PAIRS = 1024, 1 << 16, 32, 1 << 16, 1 << 15, 1 << 19
#: Most rows of a table that becomes one expression, and most that a join sends to every task; larger tables are shuffled.
EXPRESSION_ROWS, SMALL_ROWS = 256, 1_000_000


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and sorted: by size alone Spark may send a table whose few compressed MB are hundreds in the driver."""
    return df.hint("merge")


#: Nodes of ``Regions.nodes``: axis (-1 for a leaf), cut, and the nodes below and from the cut on, or the leaf.
Node = tuple[int, int, int, int]


class Regions:
    """A tree of cuts for each key with more rows than a leaf should have: space in leaves of about equal numbers of rows. It shapes the work only, so it may come from a sample."""

    def __init__(self, keys: np.ndarray, places: np.ndarray, least: int):
        self.nodes: dict[str, list[Node]] = {}
        self.leaves: dict[str, np.ndarray] = {}
        order = np.argsort(keys, kind="stable")
        names, begins = np.unique(keys[order], return_index=True)
        for name, at in zip(names, np.split(order, begins[1:]), strict=True):
            if len(at) > least:
                nodes: list[Node] = []
                self._grow(nodes, places[at], least, [0])
                self.nodes[str(name)] = nodes

    def _grow(self, nodes: list[Node], p: np.ndarray, least: int, leaves: list[int]) -> int:
        here = len(nodes)
        nodes.append((-1, 0, leaves[0], 0))
        if len(p) > least:
            axis = int(np.argmax(p.max(0) - p.min(0)))
            cut = int(np.sort(p[:, axis])[len(p) // 2])
            below = p[:, axis] < cut
            if not below.any():  # half of them share the least value
                cut += 1
                below = p[:, axis] < cut
            if below.any() and not below.all():
                low = self._grow(nodes, p[below], least, leaves)
                high = self._grow(nodes, p[~below], least, leaves)
                nodes[here] = (axis, cut, low, high)
                return here
        leaves[0] += 1
        return here

    def place(self, key: str, p: np.ndarray) -> np.ndarray:
        """The leaf of each of ``p``; 0 for a key without cuts."""
        out = np.zeros(len(p), np.int32)
        nodes = self.nodes.get(key)
        waiting = [(0, np.arange(len(p)))] if nodes else []
        while waiting:
            n, at = waiting.pop()
            axis, cut, low, high = nodes[n]
            if axis < 0:
                out[at] = low
            elif len(at):
                below = p[at, axis] < cut
                waiting += [(low, at[below]), (high, at[~below])]
        return out


def _nearest(p: np.ndarray, src: np.ndarray, s: np.ndarray, k: int, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, s, d2) of the ``k`` nearest of ``src`` (in order of s) to each of ``p``, by distance and s; ``most`` bounds the squared distances."""
    rows, ids, far = [], [], []
    step = max(1, PAIRS // max(1, len(src)))
    for i in range(0, len(p), step):
        q = p[i : i + step]
        d = (q[:, None, 0] - src[None, :, 0]) ** 2
        for axis in (1, 2):
            d += (q[:, None, axis] - src[None, :, axis]) ** 2
        if k == 1:
            c = d.argmin(1)
            r = np.arange(len(q))
        else:
            bound = np.partition(d, k - 1, 1)[:, k - 1] if len(src) > k else d.max(1)
            if most is not None:
                bound = np.minimum(bound, most[i : i + step])
            r, c = np.nonzero(d <= bound[:, None])
        v = d[r, c]
        if k > 1:
            by = np.lexsort((c, v, r))
            r, c, v = r[by], c[by], v[by]
            kept = _rank(r) < k
            r, c, v = r[kept], c[kept], v[kept]
        elif most is not None:
            kept = v <= most[i : i + step]
            r, c, v = r[kept], c[kept], v[kept]
        rows.append(r + i)
        ids.append(s[c])
        far.append(v)
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(far)


def _rank(r: np.ndarray) -> np.ndarray:
    """The place of each of the sorted ``r`` among equal ones, from 0."""
    new = np.r_[True, r[1:] != r[:-1]]
    return np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))


def _reach(p: np.ndarray, boxes: np.ndarray, k: int) -> np.ndarray:
    """A squared distance within which each of ``p`` has ``k`` sources, or all: that to the far corners of the boxes (n, low, high) nearest by them."""
    if boxes[:, 0].sum() <= k:
        return np.full(len(p), np.iinfo(np.int64).max)
    out = np.empty(len(p), np.int64)
    for i, q in enumerate(p):
        away = (np.maximum(np.abs(q - boxes[:, 1:4]), np.abs(q - boxes[:, 4:7])) ** 2).sum(1)
        order = np.argsort(away)
        out[i] = away[order[np.searchsorted(np.cumsum(boxes[order, 0]), k)]]
    return out


def _crossing(p: np.ndarray, most: np.ndarray, boxes: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of p, box) of the boxes other than ``own`` that begin within ``most`` of each of ``p``."""
    gap = lambda low, high, box: (np.maximum(np.maximum(box[:, 1:4] - high, low - box[:, 4:7]), 0) ** 2).sum(-1)
    near = np.flatnonzero((gap(p.min(0), p.max(0), boxes) <= most.max()) & (boxes[:, 0] > 0))
    near = near[near != own]
    rows, leaves = [], []
    step = max(1, PAIRS // max(1, len(near)))
    for i in range(0, len(p) if len(near) else 0, step):
        r, c = np.nonzero(np.stack([gap(q, q, boxes[near]) for q in p[i : i + step]]) <= most[i : i + step, None])
        rows.append(r + i)
        leaves.append(near[c])
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def knn_join(targets: DataFrame, sources: DataFrame, k: int, cell: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(t, s, d2, rank) of the ``k`` sources nearest to each target by squared distance, ties to the smaller source.

    Both need ``idx, x, y, z`` and the columns of ``by``, within whose values points are compared. Exact for any data:

    * A place counts once on both sides: equal targets are searched together, and of equal sources only the first ``k`` can be answers.
    * Space is cut into leaves of about ``cell`` places by medians of a sample, for each key with more of them. A place is compared with the sources of its own leaf first.
    * Where the box of another leaf's sources begins within the k-th distance, the place visits that leaf too. Leaf and visits together hold all nearest ones.

    So a place meets its leaf and a few around it, in two passes whatever the data. Only a row for each leaf is gathered.
    """
    by = list(by)
    spark, schema = targets.sparkSession, "t long, s long, d2 long, rank int"
    first = Window.partitionBy(*by, *AXES).orderBy("idx")
    known = lambda df: df.select(*(F.col(c).cast(targets.schema[c].dataType).alias(c) for c in by), "idx", *(F.col(a).cast("long").alias(a) for a in AXES)).dropna(subset=[*by, *AXES])
    named = lambda df: df.withColumn("__key", F.to_json(F.struct(*by)) if by else F.lit(""))
    src = staged(named(known(sources).withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= k).select(*by, *AXES, F.col("idx").cast("long").alias("s"))), "knn-sources")
    places = staged(named(known(targets).select(*by, *AXES).distinct()), "knn-places")
    n, n_places = src.count(), places.count()
    if not n or not n_places:
        return spark.createDataFrame([], schema)
    leaf_rows = max(cell or LEAF_ROWS, (n + n_places) // MOST_LEAVES)
    share = LEAF_SAMPLES / leaf_rows if n + n_places > SAMPLED_FROM else 1.0
    seen = [df.select("__key", *AXES).sample(share, 7).toArrow() for df in (places, src)]  # about LEAF_SAMPLES rows for each leaf
    seen = pa.concat_tables(seen)
    regions = Regions(seen["__key"].to_numpy().astype(str), np.stack([seen[a].to_numpy() for a in AXES], 1).astype(np.int64), max(1, int(2 * leaf_rows * share)))
    held = spark.sparkContext.broadcast(regions)

    @F.arrow_udf("int")
    def leaf(key: pa.Array, x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        p = np.stack([a.to_numpy(zero_copy_only=False) for a in (x, y, z)], 1)
        out, coded = np.zeros(len(p), np.int32), key.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        for i, name in enumerate(coded.dictionary.to_pylist()):
            if name in held.value.nodes:
                at = np.flatnonzero(which == i)
                out[at] = held.value.place(name, p[at])
        return pa.array(out)

    group = [*by, "__leaf"]
    at = lambda df: df.withColumn("__leaf", leaf("__key", *AXES)) if regions.nodes else df.withColumn("__leaf", F.lit(0))
    boxes: dict[str, np.ndarray] = {}
    if regions.nodes:
        ends = at(src.filter(F.col("__key").isin(list(regions.nodes)) if len(regions.nodes) <= EXPRESSION_ROWS else F.lit(True))).groupBy("__key", "__leaf").agg(F.count(F.lit(1)).alias("n"), *(f(a) for f in (F.min, F.max) for a in AXES))
        if len(regions.nodes) > EXPRESSION_ROWS:
            ends = ends.join(F.broadcast(spark.createDataFrame([(x,) for x in regions.nodes], "__key string")), "__key", "left_semi")  # at most MOST_LEAVES rows
        cut = ends.toArrow()
        for name, i, *box in zip(*(cut[c].to_pylist() for c in cut.column_names), strict=True):
            if name not in boxes:
                boxes[name] = np.zeros((sum(x[0] < 0 for x in regions.nodes[name]), 7), np.int64)
            boxes[name][i] = box
    held_boxes = spark.sparkContext.broadcast(boxes)
    fields = [targets.schema[c] for c in by]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    out_schema = StructType([*fields, *(StructField(c, LongType()) for c in (*AXES, "s", "d2")), StructField("rank", IntegerType()), StructField("__leaf", IntegerType()), StructField("__key", StringType())])

    def rows(keys: tuple, name: str, p: np.ndarray, s, d2: np.ndarray, rank, to) -> pa.Table:
        """Rows found (``to`` -1: done, -2: open), or visits (no s) to a leaf."""
        full = lambda v: np.full(len(p), v, np.int32) if np.isscalar(v) else v.astype(np.int32)
        own = [pa.array([key.as_py()] * len(p), kind) for key, kind in zip(keys, kinds, strict=False)]
        ids = pa.nulls(len(p), pa.int64()) if s is None else pa.array(s, pa.int64())
        return pa.Table.from_arrays([*own, *(pa.array(p[:, i]) for i in range(3)), ids, pa.array(d2), pa.array(full(rank)), pa.array(full(to)), pa.array([name] * len(p), pa.string())], out_schema.names)

    def arrays(t: pa.Table, *columns: str) -> np.ndarray:
        return np.stack([t[c].to_numpy() for c in columns], 1)

    def own_leaf(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        here, none = int(keys[-1].as_py()), rows(keys, "", np.zeros((0, 3), np.int64), None, np.zeros(0, np.int64), 0, 0)
        if not left.num_rows:
            return none
        name = left["__key"][0].as_py()
        known = held_boxes.value.get(name)
        if known is None and not right.num_rows:
            return none
        right = right.sort_by("s")
        p, src_p, s = arrays(left, *AXES), arrays(right, *AXES), right["s"].to_numpy()
        if known is None:
            r, ids, d2 = _nearest(p, src_p, s, k)
            return rows(keys, name, p[r], ids, d2, _rank(r) + 1, -1)
        most = np.empty(len(p), np.int64)
        if len(s) >= k:
            r, ids, d2 = _nearest(p, src_p, s, k)
            last = np.r_[r[1:] != r[:-1], True]
            most[r[last]] = d2[last]
        else:
            most[:] = _reach(p, known, k)
            r, ids, d2 = _nearest(p, src_p, s, k) if len(s) else (np.zeros(0, np.int64),) * 3
        to, there = _crossing(p, most, known, here)
        is_open = np.zeros(len(p), bool)
        is_open[to] = True
        return pa.concat_tables([rows(keys, name, p[r], ids, d2, _rank(r) + 1 if len(r) else 0, np.where(is_open[r], -2, -1)), rows(keys, name, p[to], None, most[to], 0, there)])

    def visit(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return rows(keys, "", np.zeros((0, 3), np.int64), None, np.zeros(0, np.int64), 0, 0)
        right = right.sort_by("s")
        p = arrays(left, *AXES)
        r, ids, d2 = _nearest(p, arrays(right, *AXES), right["s"].to_numpy(), k, left["d2"].to_numpy())
        return rows(keys, "", p[r], ids, d2, 0, -2)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (n + n_places) // TASK_ROWS)
    dealt = lambda df: df.repartition(tasks, *group).groupBy(*group)
    met = lambda left, f: dealt(left).cogroup(dealt(at(src).select(*group, *AXES, "s"))).applyInArrow(f, out_schema)
    found = staged(met(at(places).select(*group, *AXES, "__key"), own_leaf), "knn")
    place = [*by, *AXES]
    out = found.filter("__leaf = -1").select(*place, "s", "d2", "rank")
    if boxes:
        more = met(found.filter("__leaf >= 0").select(*group, *AXES, "d2"), visit).unionByName(found.filter("__leaf = -2"))
        ranked = more.select(*place, "s", "d2", F.row_number().over(Window.partitionBy(*place).orderBy("d2", "s")).alias("rank"))
        out = out.unionByName(ranked.filter(F.col("rank") <= k))
    return targets.select(F.col("idx").cast("long").alias("t"), *by, *(F.col(a).cast("long").alias(a) for a in AXES)).join(apart(out), place).select("t", "s", "d2", "rank")


def nearest_value(df: DataFrame, value: Column, table: DataFrame, table_value: str, table_key: str, name: str) -> DataFrame:
    """``df`` with the key of the table's row whose value is nearest, ties to the lower key.

    A table of a few hundred rows is one expression; up to ``SMALL_ROWS``, which is checked, it is sorted, sent to every task and searched by halves.
    """
    rows = table.select(table_key, table_value).orderBy(table_key).limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"nearest_value is for tables of at most {SMALL_ROWS} rows")
    if len(rows) <= EXPRESSION_ROWS:
        known = F.array(*(F.struct(F.lit(r[1]).alias("v"), F.lit(r[0]).alias("k")) for r in rows))
        best = F.array_min(F.transform(known, lambda e: F.struct(F.abs(value - e["v"]).alias("d"), e["k"].alias("k"))))
        return df.withColumn(name, best["k"])
    first: dict = {}
    for k, v in rows:  # by key, so a value keeps its lowest key
        first.setdefault(v, k)
    values, keys = np.array(sorted(first), np.float64), np.array([first[v] for v in sorted(first)], np.int64)
    held = df.sparkSession.sparkContext.broadcast((values, keys))  # at most SMALL_ROWS rows

    @F.arrow_udf("long")
    def nearest(x: pa.Array) -> pa.Array:
        known, names = held.value
        v = x.to_numpy(zero_copy_only=False).astype(np.float64)
        up = np.clip(np.searchsorted(known, v), 0, len(known) - 1)
        down = np.maximum(up - 1, 0)
        a, b = np.abs(known[up] - v), np.abs(v - known[down])
        best = np.where(b < a, names[down], np.where(a < b, names[up], np.minimum(names[up], names[down])))
        return pa.array(best, pa.int64(), mask=np.isnan(v))

    return df.withColumn(name, nearest(value.cast("double")))


def first_box(df: DataFrame, boxes: DataFrame, value: str, default: int) -> DataFrame:
    """``df`` with the value of the first box, by ``ord``, that holds the point. A few hundred boxes are one expression; more go by ``tiled_boxes``."""
    rows = boxes.orderBy("ord").limit(EXPRESSION_ROWS + 1).collect()
    if len(rows) > EXPRESSION_ROWS:
        return tiled_boxes(df, boxes, value, default)
    known = F.array(*(F.struct(*(F.lit(r[f"{m}_{a}"]).alias(f"{m}_{a}") for m in ("min", "max") for a in AXES), F.lit(r[value]).alias("value")) for r in rows)) if rows else None
    if known is None:
        return df.withColumn(value, F.lit(default))
    return df.withColumn(value, F.coalesce(F.get(F.filter(known, _inside), F.lit(0))["value"], F.lit(default)))


def _inside(b: Column) -> Column:
    return fold(lambda p, q: p & q, (F.col(a).between(b[f"min_{a}"], b[f"max_{a}"]) for a in AXES))


def tiled_boxes(df: DataFrame, boxes: DataFrame, value: str, default: int, cell: int | None = None) -> DataFrame:
    """``first_box`` for any number of boxes: boxes are listed by the cells of x that they span, and a point meets the list of its cell.

    Cells are as wide as the average box, so a list holds the boxes that overlap there.
    """
    if cell is None:
        cell = max(1, math.ceil(boxes.agg(F.avg(F.col("max_x") - F.col("min_x") + 1)).first()[0] or 1))
    span = F.explode(F.sequence(F.floor(F.col("min_x") / cell), F.floor(F.col("max_x") / cell))).alias("__cell")
    each = boxes.select(span, F.struct("ord", *(f"{m}_{a}" for m in ("min", "max") for a in AXES), F.col(value).alias("value")).alias("b"))
    lists = each.groupBy("__cell").agg(F.sort_array(F.collect_list("b")).alias("__boxes"))
    met = df.withColumn("__cell", F.floor(F.col("x") / cell)).join(lists, "__cell", "left")
    found = F.get(F.filter("__boxes", _inside), F.lit(0))["value"]
    return met.select(*df.columns, F.coalesce(found, F.lit(default)).alias(value))


def asof_next(df: DataFrame, reference: DataFrame, key: str | list[str], by: str, order: str = "idx", skip: int = 0) -> DataFrame:
    """``df`` with the reference row (``ref_by``, ``ref_id``) of the next larger ``by`` within ``key``; ``skip`` goes that many further.

    One shuffle by key: both sides are united, and a running window from the largest ``by`` down keeps the last reference row met.
    Reference rows that share ``by`` count once, by their first in ``order``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    firsts = reference.groupBy(*keys, by).agg(F.min(order).alias("ref_id"))
    if skip:
        w = Window.partitionBy(*keys).orderBy(by)
        firsts = firsts.select(*keys, by, F.lead("ref_id", skip).over(w).alias("ref_id"), F.lead(by, skip).over(w).alias("ref_by"))
    else:
        firsts = firsts.withColumn("ref_by", F.col(by))
    none = F.lit(None)
    rows = df.select("*", none.cast("long").alias("ref_id"), none.cast("long").alias("ref_by"), F.lit(1).alias("__own"))
    refs = firsts.select(*keys, by, F.col("ref_id").cast("long"), F.col("ref_by").cast("long"), F.lit(0).alias("__own"))
    both = rows.unionByName(refs, allowMissingColumns=True)
    # strictly larger: among equal values the own rows stand before the reference rows
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col("__own").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ref = F.last(F.when(F.col("__own") == 0, F.struct("ref_id", "ref_by")), ignorenulls=True).over(w)
    return both.withColumn("__ref", ref).filter("__own = 1").select(*df.columns, F.col("__ref.ref_id").alias("ref_id"), F.col("__ref.ref_by").alias("ref_by"))


def near_blocks(df: DataFrame, reference: DataFrame, block: int, within: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose block is touched by a reference point (of equal ``by``) moved by -+ ``within`` on any axis: explode, distinct, semi join."""
    offsets = F.array(*(F.struct(*(F.lit(s * within).alias(a) for s, a in zip(signs, AXES, strict=True))) for signs in ((i, j, m) for i in (-1, 1) for j in (-1, 1) for m in (-1, 1))))
    touched = reference.select(*by, *(F.col(a).alias(f"p{a}") for a in AXES), F.explode(offsets).alias("o")).select(*by, *(F.floor((F.col(f"p{a}") + F.col(f"o.{a}")) / block).alias(f"b{a}") for a in AXES)).distinct()
    keyed = df.select("*", *(F.floor(F.col(a) / block).alias(f"b{a}") for a in AXES))
    return keyed.join(touched, [*by, *(f"b{a}" for a in AXES)], "left_semi").select(*df.columns)


def node_neighbours(df: DataFrame, bits: int) -> DataFrame:
    """Occupied nodes with a mask of their six face neighbours that are occupied."""
    nodes = df.select(*(F.shiftright(F.col(a), bits).alias(f"n{a}") for a in AXES)).distinct()
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    toward = F.array(*(F.struct(*(F.lit(v).alias(f"d{a}") for v, a in zip(s, AXES, strict=True)), F.lit(1 << i).alias("bit")) for i, s in enumerate(steps)))
    seen_by = nodes.select(*(f"n{a}" for a in AXES), F.explode(toward).alias("s")).select(*((F.col(f"n{a}") - F.col(f"s.d{a}")).alias(f"n{a}") for a in AXES), F.col("s.bit").alias("bit"))
    # a node that is there lends its bit to the neighbour that looks at it
    each = seen_by.unionByName(nodes.withColumn("bit", F.lit(0))).groupBy(*(f"n{a}" for a in AXES)).agg(F.bit_or("bit").alias("mask"), F.max((F.col("bit") == 0).cast("int")).alias("own"))
    return each.filter("own = 1").select("nx", "ny", "nz", "mask")


def near_nodes(df: DataFrame, bits: int, steps: list[tuple[int, int, int]]) -> DataFrame:
    """(nx, ny, nz, found): occupied nodes with a bit for each of ``steps`` that leads to an occupied node. Every node tells those that look at it, so it is one aggregate."""
    nodes = df.select(*(F.shiftright(F.col(a), bits).alias(f"n{a}") for a in AXES)).distinct()
    looks = F.array(*(F.struct(*(F.lit(v).alias(f"d{a}") for v, a in zip(s, AXES, strict=True)), F.lit(1 << i).alias("bit")) for i, s in enumerate(sorted(steps))))
    told = nodes.select(*(f"n{a}" for a in AXES), F.explode(looks).alias("l")).select(*((F.col(f"n{a}") - F.col(f"l.d{a}")).alias(f"n{a}") for a in AXES), F.col("l.bit").alias("bit"))
    both = told.withColumn("own", F.lit(0)).unionByName(nodes.withColumn("bit", F.lit(0)).withColumn("own", F.lit(1)))
    return both.groupBy(*(f"n{a}" for a in AXES)).agg(F.bit_or("bit").alias("found"), F.max("own").alias("own")).filter("own = 1").select("nx", "ny", "nz", "found")


def touching_children(nodes: DataFrame) -> DataFrame:
    """(nx, ny, nz, nodes, touching) of nodes with an occupancy byte: a bit for each face whose neighbour is there, and for each whose neighbour has a child at that face."""
    steps = [((1, 0, 0), 15), ((-1, 0, 0), 240), ((0, 1, 0), 51), ((0, -1, 0), 204), ((0, 0, 1), 85), ((0, 0, -1), 170)]
    looks = F.array(*(F.struct(*(F.lit(v).alias(f"d{a}") for v, a in zip(s, AXES, strict=True)), F.lit(1 << i).alias("bit"), F.lit(face).alias("face")) for i, (s, face) in enumerate(steps)))
    told = nodes.select(*(f"n{a}" for a in AXES), "occupancy", F.explode(looks).alias("l")).select(*((F.col(f"n{a}") - F.col(f"l.d{a}")).alias(f"n{a}") for a in AXES), F.col("l.bit").alias("there"), F.when(F.col("occupancy").bitwiseAND(F.col("l.face")) > 0, F.col("l.bit")).otherwise(0).alias("near"), F.lit(0).alias("own"))
    own = nodes.select(*(f"n{a}" for a in AXES), F.lit(0).alias("there"), F.lit(0).alias("near"), F.lit(1).alias("own"))
    return told.unionByName(own).groupBy(*(f"n{a}" for a in AXES)).agg(F.bit_or("there").alias("nodes"), F.bit_or("near").alias("touching"), F.max("own").alias("own")).filter("own = 1").drop("own")
