"""Exact top-k inner products by dual-tree cover-tree search, over blocks.

Vectors become integers, floor(256 x). Rows are dealt to cells around a bounded number of pivots, the top of
a joint cover tree over queries and data, and each cell into blocks of at most about ``BLOCK`` rows, each with
a cover tree of its own; queries likewise. A block of queries first searches the data blocks of its own
cell, which gives each query a score that k rows reach; it then meets only the cells whose covering radius allows
more than the worst of those. What a pair of blocks finds is at most k rows a query; the last step keeps the best k.

Of rows with equal vectors only the k + 1 smallest ids can be an answer, so the others are dropped as candidates,
never as queries; that keeps a vector which a third of the rows share from filling a cell.

Cases: null vectors, empty ones and those with null or non-finite components take no part; vectors of different lengths are never compared; a null id takes no part; ties
go to the smaller id; a row that repeats an id is an answer of its own but never one to its own id, and queries that share an id are answered together; a query with fewer candidates gets all of them; an empty
table gives no rows; components too large for exact 64-bit products give scores at the ends of the 64-bit range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import staged
from cloudloom.llm.covertree import LEAF, QUERY_LEAF, Best, Tree, search

#: Cells of a small table; a large one has one for every ``CELL_BLOCKS`` blocks, ``MOST_PIVOTS`` at most.
PIVOTS, MOST_PIVOTS, CELL_BLOCKS, SAMPLED = 32, 512, 16, 4096
BLOCK, QUERY_BLOCK = 2048, 512
FOUND = "query_id long, vec_id long, score long"


def integers(vector: Column) -> Column:
    """floor(256 x) of each component, null where the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), whole.cast("array<bigint>"))


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, rows far from each other, of a sample of ``SAMPLED`` by id hash, in a number that follows the table's. They shape the cells; every row is searched."""
    most = min(MOST_PIVOTS, max(PIVOTS, rows.count() // (CELL_BLOCKS * BLOCK)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLED).collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r["vector"]), []).append(r["vector"])
    out = {}
    for d, vectors in by.items():
        x = np.array(vectors, np.float64)
        chosen, gap = [0], np.sqrt(((x - x[0]) ** 2).sum(1))
        while len(chosen) < min(most, max(1, len(x) // 8)) and gap.max() > 0:
            chosen.append(int(np.argmax(gap)))
            gap = np.minimum(gap, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
        out[d] = x[chosen]
    return out


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with the nearest pivot's number as ``cell`` and the distance to it as ``away``."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS rows a vector length

    @F.arrow_udf("cell int, away double")
    def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = held.value
        for batch in batches:
            cells, away = [], []
            for v in batch.to_pylist():
                p = known.get(len(v))
                if p is None:
                    cells.append(0)
                    away.append(float(np.sqrt(np.square(np.array(v, np.float64)).sum())))
                    continue
                gap = np.sqrt(((p - np.array(v, np.float64)) ** 2).sum(1))
                cells.append(int(np.argmin(gap)))
                away.append(float(gap.min()))
            yield pa.StructArray.from_arrays([pa.array(cells, pa.int32()), pa.array(away, pa.float64())], ["cell", "away"])

    return rows.withColumn("__at", placed("vector")).select("id", "vector", F.size("vector").alias("d"), "__at.*")


def _blocks(rows: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """(d, cell, block, packed): ids and integers of at most about ``size`` rows as bytes."""
    # a row for each cell, at most MOST_PIVOTS a vector length; sent to all tasks, so that rows are dealt by block and not by cell
    dealt = rows.join(F.broadcast(cells.select("d", "cell", F.ceil(F.col("n") / size).cast("int").alias("parts"))), ["d", "cell"])
    dealt = dealt.select("d", "cell", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int").alias("block"), "id", "vector")

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        values = t["vector"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)[order]
        narrow = np.int32 if np.abs(values).max(initial=0) < 2**31 else np.int64
        ids = t["id"].to_numpy()[order].astype(np.int64)
        return pa.table({"d": t["d"][:1], "cell": t["cell"][:1], "block": t["block"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "rows": pa.array([values.astype(narrow).tobytes()], pa.binary()), "wide": pa.array([narrow is np.int64], pa.bool_())})

    return dealt.groupBy("d", "cell", "block").applyInArrow(pack, "d int, cell int, block int, ids binary, rows binary, wide boolean")


def _tree(ids: bytes, rows: bytes, wide: bool, d: int, leaf: int = LEAF) -> Tree:
    return Tree(np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64 if wide else np.int32).reshape(-1, d).astype(np.int64), leaf)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of each query in each pair of blocks: rows (query_id, vec_id, score)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[tuple, Tree] = {}
        trees: dict[tuple, Tree] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                key = (r["d"], r["cell"], r["block"])
                if key not in built:
                    if len(built) >= 16:
                        built.clear()
                    built[key] = _tree(r["ids"], r["rows"], r["wide"], r["d"])
                data = built[key]
                q = (r["d"], r["q_cell"], r["q_block"])
                if q not in trees:
                    if len(trees) >= 16:
                        trees.clear()
                    trees[q] = _tree(r["q_ids"], r["q_rows"], r["q_wide"], r["d"], QUERY_LEAF)
                queries = trees[q]
                floor = None
                if r["q_floor"] is not None:
                    known = dict(zip(np.frombuffer(r["q_ids"], np.int64).tolist(), np.frombuffer(r["q_floor"], np.int64).tolist(), strict=True))
                    floor = np.array([known[x] for x in queries.ids.tolist()], np.int64)
                best = Best.empty(len(queries.ids), k, floor)
                search(queries, data, best)
                have = best.ids < np.iinfo(np.int64).max
                yield pa.record_batch([pa.array(np.repeat(queries.ids, k)[have.ravel()]), pa.array(best.ids[have]), pa.array(best.scores[have])], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(found, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows with the largest products for each row that ``is_query`` marks."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("vector"), is_query.alias("asks")).filter("id is not null and vector is not null")
    pivots = _pivots(rows.select("id", "vector"))
    alike = Window.partitionBy("vector").orderBy("id")
    # rows that repeat an id and its vector are one until the end: at most k of them can be answers
    once = rows.groupBy("id", "vector").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("m"))
    kept = once.withColumn("same", F.row_number().over(alike)).filter(F.col("same") <= k + 1)
    candidates = kept.select("id", "vector", F.explode(F.sequence(F.lit(1), F.col("m")))).select("id", "vector")
    data = staged(_placed(candidates, pivots), "data")
    queries = staged(_placed(rows.filter("asks").select("id", "vector").distinct(), pivots), "queries")
    count = [F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")]
    data_cells, query_cells = (x.groupBy("d", "cell").agg(*count) for x in (data, queries))
    blocks = staged(_blocks(data, data_cells, BLOCK), "blocks")
    asking = _blocks(queries, query_cells, QUERY_BLOCK).select("d", F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("wide").alias("q_wide"))
    asking = staged(asking, "asking")

    home = asking.withColumn("cell", F.col("q_cell")).withColumn("q_floor", F.lit(None).cast("binary")).join(blocks, ["d", "cell"])
    near = staged(_best(_search(home, k), k), "near")
    floors = near.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    radii = {(r["d"], r["cell"]): r["radius"] for r in data_cells.collect()}  # at most MOST_PIVOTS rows a vector length
    with_floor = _floored(asking, floors)
    reach = _reached(with_floor, radii, pivots)
    far = _search(reach.join(blocks, ["d", "cell"]), k)
    return _best(near.select("query_id", "vec_id", "score").unionByName(far), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floored(asking: DataFrame, floors: DataFrame) -> DataFrame:
    """Query blocks with the floors of their queries, packed in the order of their ids; the lowest number where none is known."""
    ids = asking.select("d", "q_cell", "q_block", F.explode(_unpacked("q_ids")).alias("query_id"))
    low = -(2**63)
    each = ids.distinct().join(floors, "query_id", "left").select("d", "q_cell", "q_block", F.struct("query_id", F.coalesce("floor", F.lit(low)).alias("floor")).alias("f"))
    lists = each.groupBy("d", "q_cell", "q_block").agg(F.sort_array(F.collect_list("f")).alias("floors"))  # at most about QUERY_BLOCK entries
    return asking.join(lists, ["d", "q_cell", "q_block"])


def _unpacked(name: str) -> Column:
    @F.arrow_udf("array<long>")
    def longs(x: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(v, np.int64).tolist() for v in x.to_pylist()], pa.list_(pa.int64()))

    return longs(F.col(name))


def _reached(asking: DataFrame, radii: dict, pivots: dict[int, np.ndarray]) -> DataFrame:
    """A row for each query block and other cell that can hold more than its worst floor."""
    held = asking.sparkSession.sparkContext.broadcast((radii, pivots))
    fields = "d int, q_cell int, q_block int, q_ids binary, q_rows binary, q_wide boolean, q_floor binary, cell int"

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius_of, known = held.value
        for batch in batches:
            for r in batch.to_pylist():
                d, ids = r["d"], np.frombuffer(r["q_ids"], np.int64)
                x = np.frombuffer(r["q_rows"], np.int64 if r["q_wide"] else np.int32).reshape(-1, d).astype(np.float64)
                of = {f["query_id"]: f["floor"] for f in r["floors"]}
                floor = np.array([of[i] for i in ids.tolist()], np.int64)
                norms = np.sqrt((x**2).sum(1))
                cells = []
                for (dd, cell), radius in radius_of.items():
                    if dd != d or cell == r["q_cell"]:
                        continue
                    pivot = known[d][cell] if d in known else np.zeros(d)
                    bound = x @ pivot + norms * radius
                    if (bound + np.abs(bound) * 1e-9 + 1e-6 >= floor).any():
                        cells.append(cell)
                n = len(cells)
                yield pa.record_batch([pa.array([d] * n, pa.int32()), pa.array([r["q_cell"]] * n, pa.int32()), pa.array([r["q_block"]] * n, pa.int32()), pa.array([r["q_ids"]] * n, pa.binary()), pa.array([r["q_rows"]] * n, pa.binary()), pa.array([r["q_wide"]] * n, pa.bool_()), pa.array([floor.tobytes()] * n, pa.binary()), pa.array(cells, pa.int32())], [f.split(" ")[0] for f in fields.split(", ")])

    return asking.mapInArrow(reach, fields)
