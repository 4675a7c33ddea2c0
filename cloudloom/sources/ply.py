"""PLY point files, ascii and binary, by name-and-width inference from the header.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reads will do, and parsed in Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type names of the format and their numpy kinds.
TYPES = {"float64": "f8", "double": "f8", "float32": "f4", "float": "f4", "uint64": "u8", "uint32": "u4", "uint16": "u2", "uint8": "u1", "uchar": "u1", "int64": "i8", "int32": "i4", "int16": "i2", "int8": "i1", "char": "i1"}
COLOURS = {"green": "c0", "blue": "c1", "red": "c2"}
SCHEMA = "path string, frame int, idx long, x int, y int, z int, c0 int, c1 int, c2 int, refl int, frameindex int, laser_angle int"


def parse_header(data: bytes) -> tuple[str, int, list[tuple[str, str]], int]:
    """(format, points, (name, type) of each property, length of the header); raises on a type it does not know."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    stop = data.index(b"\n", end) + 1
    kind, count, properties = "", 0, []
    for line in data[:stop].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:2] == ["element", "vertex"]:
            count = int(words[2])
        elif words[:1] == ["property"]:
            if words[1] not in TYPES:
                raise ValueError(f"unknown property type {words[1]}")
            properties.append((words[2], words[1]))
    return kind, count, properties, stop


def parse(data: bytes, scale: float = 1.0, names: tuple[str, str, str] = ("x", "y", "z")) -> dict[str, np.ndarray]:
    """Columns of one file; positions are multiplied and cut toward zero. Normals are left out."""
    kind, count, properties, stop = parse_header(data)
    if kind == "ascii":
        rows = [line.split() for line in data[stop:].decode("ascii").splitlines() if line.strip()][:count]
        raw = {name: np.array([float(r[i]) for r in rows]) for i, (name, _) in enumerate(properties)}
    else:
        order = ">" if kind == "binary_big_endian" else "<"
        table = np.frombuffer(data, np.dtype([(f"{i}", order + TYPES[t]) for i, (_, t) in enumerate(properties)]), count, stop)
        raw = {name: table[str(i)].astype(np.float64) for i, (name, _) in enumerate(properties)}
    missing = [n for n in names if n not in raw]
    if missing:
        raise ValueError(f"no property {missing[0]}")
    out = {a: np.trunc(raw[n] * scale).astype(np.int32) for a, n in zip("xyz", names, strict=True)}
    if all(n in raw for n in COLOURS):
        out |= {c: raw[n].astype(np.int32) for n, c in COLOURS.items()}
    for n, c in (("reflectance", "refl"), ("refc", "refl"), ("frameindex", "frameindex")):
        if n in raw:
            out[c] = raw[n].astype(np.int32)
    if "laserangle" in raw:
        out["laser_angle"] = np.round(raw["laserangle"]).astype(np.int32)
    return out


def read_ply(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """All points of the files that ``path`` (a glob) names; ``frame`` is the last number in a file's name. Absent columns are null."""
    files = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"(\d+)\D*$", 1).cast("int").alias("frame"), "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split(" ") for f in SCHEMA.split(", ")]
        for batch in batches:
            for name, frame, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = parse(data, scale)
                n = len(got["x"])
                for a in range(0, max(n, 1), 100_000):
                    m = min(n - a, 100_000)
                    known = {"path": pa.array([name] * m, pa.string()), "frame": pa.array([frame] * m, pa.int32()), "idx": pa.array(np.arange(a, a + m), pa.int64())}
                    known |= {c: pa.array(v[a : a + m], pa.int32()) for c, v in got.items()}
                    yield pa.record_batch([known.get(c, pa.nulls(m, pa.int32())) for c, _ in fields], [c for c, _ in fields])

    return files.mapInArrow(rows, SCHEMA)


def format_ply(columns: dict[str, np.ndarray], ascii_: bool = False, scale: float = 1.0, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> bytes:
    """One file: positions ``p * scale + offset`` as doubles (five decimals in ascii), colours, reflectance and frame index where given."""
    n = len(columns["x"])
    fields = [("x", "float64"), ("y", "float64"), ("z", "float64")]
    values = [columns[a].astype(np.float64) * scale + o for a, o in zip("xyz", offset, strict=True)]
    extra = [("green", "uint8", "c0"), ("blue", "uint8", "c1"), ("red", "uint8", "c2"), ("reflectance", "uint16", "refl"), ("frameindex", "uint8", "frameindex")]
    for name, kind, column in extra:
        if column in columns:
            fields.append((name, kind))
            values.append(columns[column])
    head = f"ply\nformat {'ascii' if ascii_ else 'binary_little_endian'} 1.0\nelement vertex {n}\n" + "".join(f"property {t} {m}\n" for m, t in fields) + "element face 0\nend_header\n"
    if ascii_:
        lines = ("".join(f"{v[i]:.5f} " if k < 3 else f"{int(v[i])} " for k, v in enumerate(values)).strip() + "\n" for i in range(n))
        return head.encode() + "".join(lines).encode()
    table = np.empty(n, np.dtype([(str(i), "<" + TYPES[t]) for i, (_, t) in enumerate(fields)]))
    for i, v in enumerate(values):
        table[str(i)] = v
    return head.encode() + table.tobytes()


def write_ply(df: DataFrame, path: str, pattern: str = "frame%04d.ply", ascii_: bool = False) -> DataFrame:
    """A file for each ``frame``, rows in order of ``idx``; gives (frame, file, points). Written under a temporary name, then moved."""
    columns = [c for c in ("x", "y", "z", "c0", "c1", "c2", "refl", "frameindex") if c in df.columns]

    def store(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        t = pa.Table.from_batches(batches).sort_by("idx")
        where, root = fs.FileSystem.from_uri(path)
        name, frame = pattern % key[0].as_py(), key[0].as_py()
        where.create_dir(root, recursive=True)
        temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        with where.open_output_stream(temporary) as out:
            out.write(format_ply({c: t[c].to_numpy() for c in columns}, ascii_))
        where.move(temporary, f"{root}/{name}")
        yield pa.record_batch([pa.array([frame], pa.int32()), pa.array([name]), pa.array([t.num_rows], pa.int64())], ["frame", "file", "points"])

    return df.select(F.col("frame").cast("int").alias("frame"), "idx", *columns).groupBy("frame").applyInArrow(store, "frame int, file string, points long")
