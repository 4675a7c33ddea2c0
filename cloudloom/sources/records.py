"""Typed byte records, packed attribute columns, motion files, and the text reports of experiments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def records_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, payload) of a stream of one type byte, a big-endian length of four, and the payload."""
    at = 0
    while at < len(data):
        if at + 5 > len(data):
            raise ValueError("the stream ends inside a record's head")
        size = int.from_bytes(data[at + 1 : at + 5], "big")
        if at + 5 + size > len(data):
            raise ValueError("the stream ends inside a record")
        yield data[at], data[at + 5 : at + 5 + size]
        at += 5 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, type, payload) of the record files that ``path`` names."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = list(records_of(data))
                yield pa.record_batch([pa.array([name] * len(got), pa.string()), pa.array(range(len(got)), pa.int64()), pa.array([t for t, _ in got], pa.int16()), pa.array([p for _, p in got], pa.binary())], ["path", "seq", "type", "payload"])

    return files.mapInArrow(rows, "path string, seq long, type short, payload binary")


def record_bytes(kind: Column, payload: Column) -> Column:
    """A record as bytes: type, length, payload."""
    head = F.concat(F.lpad(F.hex(kind.cast("int")), 2, "0"), F.lpad(F.hex(F.octet_length(payload)), 8, "0"))
    return F.concat(F.unhex(head), payload)


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Values in row order, ``bits`` each from the highest, filled up to whole bytes."""
    spread = (values.astype(np.uint32)[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel()).tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    spread = np.unpackbits(np.frombuffer(data, np.uint8))[: bits * count].reshape(count, bits).astype(np.int64)
    return spread @ (1 << np.arange(bits - 1, -1, -1))


def pack_column(df: DataFrame, key: str, value: str, bits: int) -> DataFrame:
    """(key, count, payload): each slice's column as packed bits in order of idx."""

    def run(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by("idx")
        yield pa.record_batch([pa.array([keys[0].as_py()], pa.string()), pa.array([t.num_rows], pa.int64()), pa.array([pack_bits(t["v"].to_numpy(), bits)], pa.binary())], ["slice", "count", "payload"])

    rows = df.select(F.col(key).cast("string").alias("slice"), "idx", F.col(value).cast("int").alias("v"))
    return rows.groupBy("slice").applyInArrow(run, "slice string, count long, payload binary")


def unpack_column(packed: DataFrame, bits: int) -> DataFrame:
    """(slice, place, value) of packed columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, count, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.record_batch([pa.array([name] * count, pa.string()), pa.array(range(count), pa.int64()), pa.array(unpack_bits(payload, bits, count), pa.int64())], ["slice", "place", "value"])

    return packed.select("slice", "count", "payload").mapInArrow(run, "slice string, place long, value long")


def motion_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, v): the words of every line of 14, numbered within their file. A file of motion has a line a frame and is one row, so no split cuts its numbering."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.filter(F.transform(F.split("value", r"\r?\n"), words), lambda v: F.size(v) == 14)).alias("frame", "v"))
    return files.select("path", F.col("frame").cast("long").alias("frame"), "v")


def words(line: Column) -> Column:
    """The words of a line of a header or of rows, between blanks, tabs and carriage returns."""
    return F.split(F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", ""), r"[ \t\r]+")


def read_motion(spark: SparkSession, path: str) -> DataFrame:
    """Motion rows of a text file, a line a frame of 14 numbers: nine of a matrix, three of a translation, two heights.

    The matrix is kept in 16 fractional bits, its diagonal by the distance from one. Frames are numbered from 0 within each file.
    """
    lines = motion_lines(spark, path)
    n = [F.col("v")[i].cast("double") for i in range(14)]
    fixed = lambda i: F.round((n[i] - float(i % 4 == 0)) * 65536).cast("int") + (65536 if i % 4 == 0 else 0)
    return lines.select("frame", *(fixed(i).alias(f"m{i // 3}{i % 3}") for i in range(9)), *(F.round(n[9 + i]).cast("int").alias(f"t{i}") for i in range(3)), F.round(n[12]).cast("int").alias("z_top"), F.round(n[13]).cast("int").alias("z_bottom"))


def numbered_files(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with the number in each path as ``frame``."""
    return df.withColumn("frame", F.regexp_extract(path, r"(\d+)\D*$", 1).cast("int"))


def path_of(pattern: str, frame: Column) -> Column:
    """A path with its printf number filled in."""
    return F.format_string(pattern, frame)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV: leading # lines are comments, blank header cells get names by place."""
    rows = spark.read.csv(path, comment="#", header=True)
    return rows.toDF(*(c if c and not c.startswith("_c") else f"column_{i}" for i, c in enumerate(rows.columns)))


#: What each report line is called and the column it fills.
REPORT_LINES = {
    "positions": r"positions bitstream size (\d+) B",
    "colors": r"colors bitstream size (\d+) B",
    "reflectances": r"reflectances bitstream size (\d+) B",
    "total_bytes": r"Total bitstream size (\d+) B",
    "wall_seconds": r"Processing time \(wall\): ([0-9.]+) s",
    "user_seconds": r"Processing time \(user\): ([0-9.]+) s",
    "max_rss": r"Maximum resident set size \(kbytes\): (\d+)",
    "vertices": r"element vertex (\d+)",
    "mse_d1": r"mseF\s+\(p2point\): ([0-9.e+-]+)",
    "psnr_d1": r"mseF,PSNR \(p2point\): ([0-9.e+-]+)",
    "hausdorff": r"h\.\s+\(p2point\): ([0-9.e+-]+)",
}


def scrape(lines: DataFrame, *keys: str, text: str = "value") -> DataFrame:
    """Sums by key of the numbers that the known report lines hold: one pass, a column for each kind of line."""
    found = {name: F.regexp_extract(F.col(text), pattern, 1) for name, pattern in REPORT_LINES.items()}
    return lines.groupBy(*keys).agg(*(F.sum(F.when(v != "", v.cast("double"))).alias(name) for name, v in found.items()))


def experiment_matrix(sequences: DataFrame, variants: DataFrame, options: DataFrame) -> DataFrame:
    """Every sequence with every variant and the options that hold for its category, all small tables; the last option of a name wins."""
    both = sequences.crossJoin(F.broadcast(variants))
    chosen = both.join(options, (both.category == options.for_category) & (options.for_variant.isNull() | (both.variant == options.for_variant)))
    return chosen.groupBy("sequence", "variant", "option").agg(F.max_by("value", "ord").alias("value"))
