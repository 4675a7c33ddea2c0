"""Weighted rendezvous hashing of stable record keys over shards, in DataFrame expressions alone.

Every (key, shard) pair has a score ``-ln(u) / weight`` with u from MD5; the lowest score wins. A shard
that is added only takes the records it wins, so with n equal shards about 1/(n+1) of them move, all of
them into the new shard.

Slots follow the hash of the key, and are numbered without a task that sees a whole shard: rows are dealt by (shard,
cell) where a cell is a range of hashes and the number of cells grows with the table, numbered in their
cell, and moved by the counts of the cells before. They don't depend on the number of cells. A cell that is too full, because
many rows share a key, is cut at that key: its rows are dealt by ranges of their text's CRC, and rows that are equal in all of this are counted, and only numbered one by one at the end.

Cases: a null key is hashed as the text ``null``; null texts have no bytes and the CRC of the empty
text; equal texts under different keys are placed by their keys; repeated rows share a shard and take
slots of their own; an empty table gives an empty table; columns other than key and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import utf8_crc32

#: Hash digits used: 13 hexadecimal digits, 52 bits, which a double holds exactly.
DIGITS, SPAN = 13, float(1 << 52)
#: The order of slots, and how many times the wanted rows a cell may hold before it is cut.
ORDER = ["__hash", "__key", "text_crc32", "size"]
FULL = 4


def score(key: Column, shard: Column, weight: Column) -> Column:
    """The rendezvous score of ``key`` at ``shard``: exponential with rate ``weight``."""
    digits = F.substring(F.md5(F.concat_ws(":", key, shard.cast("string")).cast("binary")), 1, DIGITS)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 1.0) / SPAN) / weight


def place(key: Column, weights: list[float], first: int = 0) -> Column:
    """The shard of ``key``: the lowest score, ties to the lower shard."""
    shards = F.array(*(F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)))
    return F.array_min(F.transform(shards, lambda s: F.struct(score(key, s["shard"], s["weight"]).alias("score"), s["shard"].alias("shard"))))


def shard(df: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, grown_weight: float | None = 1.0, cell_rows: int = 200_000) -> DataFrame:
    """Deal rows over ``len(weights)`` shards; also where they would be with one more shard of ``grown_weight``."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    best = F.col("__best")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col), key.alias("__key"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), utf8_crc32(text).alias("text_crc32"))
    rows = rows.withColumn("__best", place(F.col("__key"), weights))
    if grown_weight is None:
        grown = F.lit(None).cast("int")
    else:
        new = F.lit(len(weights))
        grown = F.when(score(F.col("__key"), new, F.lit(float(grown_weight))) < best["score"], new).otherwise(best["shard"]).cast("int")
    rows = rows.select(id_col, "__key", "size", "text_crc32", best["shard"].cast("int").alias("shard"), grown.alias("grown_shard"))

    cells = max(16, -(-df.count() // (cell_rows * len(weights))))
    rows = rows.withColumn("__hash", F.md5(F.col("__key").cast("binary")))
    rows = rows.withColumn("__cell", F.floor(F.conv(F.substring("__hash", 1, DIGITS), 16, 10).cast("double") / SPAN * cells).cast("int"))
    counts = rows.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__cell", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    full = starts.filter(F.col("__n") > FULL * cell_rows)
    placed = rows.join(starts, ["shard", "__cell"])
    if full.isEmpty():
        within = Window.partitionBy("shard", "__cell").orderBy(*ORDER)
        numbered = placed.withColumn("slot", F.col("__start") + F.row_number().over(within) - 1)
    else:
        numbered = _numbered(placed, cell_rows)
    return numbered.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _numbered(placed: DataFrame, cell_rows: int) -> DataFrame:
    """``placed`` with ``slot`` where cells hold keys of many rows."""
    cell = ["shard", "__cell"]
    hot = placed.filter(F.col("__n") > FULL * cell_rows).groupBy(*cell, "__hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
    cuts = hot.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("__hash", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts")))).alias("__cuts"))  # fewer than a cell's rows over cell_rows
    rows = placed.join(cuts, cell, "left").withColumn("__cuts", F.coalesce("__cuts", F.expr("cast(array() as array<struct<__hash:string,parts:int>>)")))
    # segments of a cell alternate: rows before the first hot key, those of the first, those between, ...
    own = F.get(F.filter("__cuts", lambda c: c["__hash"] == F.col("__hash")), F.lit(0))["parts"]
    segment = 2 * F.size(F.filter("__cuts", lambda c: c["__hash"] < F.col("__hash"))) + own.isNotNull().cast("int")
    part = F.coalesce(F.floor(F.col("text_crc32") / float(1 << 32) * own), F.lit(0)).cast("int")
    rows = rows.withColumns({"__segment": segment, "__part": part}).drop("__cuts", "__n")
    fine = [*cell, "__segment", "__part"]
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    sizes = alike.groupBy(*fine).agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(*cell).orderBy("__segment", "__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*fine, F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__begin"))
    within = Window.partitionBy(*fine).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__start") + F.col("__begin") + F.coalesce(F.sum("__n").over(within), F.lit(0))
    return alike.join(begins, fine).withColumn("__first", first).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).alias("__i")).withColumn("slot", F.col("__first") + F.col("__i"))
