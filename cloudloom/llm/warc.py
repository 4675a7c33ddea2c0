"""A deterministic, sharded WARC writer, and a reader of what it wrote.

Records are dealt to shards by ranges of their key and payload digest. The cuts come from running sums of payload bytes over the sorted
keys, so they depend on the table alone and hold for keys of any distribution, one key of many rows included. Each shard is sorted by key and digest and
written to files that are rolled at a compressed size; every record is its own gzip member without
a time stamp, its headers, identifier and digests are made from the row, so equal tables give equal
bytes whatever the cluster. A task writes under a temporary name and renames; a task that runs again
renames the same bytes over the same name. The manifest, written last and renamed too, lists the files
that count.

Payloads that repeat are stored once: of rows with equal payloads of ``least_dedup`` bytes or more the
one with the largest key is a ``response``, the others are ``revisit`` records that carry the HTTP header,
the digest of the full payload and a reference.

Cases: a null payload is empty; a null key sorts first and never wins a reference over a key; rows that
share the largest key are responses all; a null or odd address is replaced or percent-encoded; a payload of any
length is one record; an empty table gives an empty manifest and no file; a path that holds a manifest is refused; keys must be integers; columns that are not named in the call are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import pieces, staged

#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:cloudloom:warc-record")
MANIFEST_FIELDS = "file string, shard int, number int, records long, bytes long, sha1 string, first_key long, last_key long"


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key}:{digest}')}>"


def make_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit."""
    raw = hashlib.sha1(payload)
    digest, revisit = raw.hexdigest(), refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~') if url else f'urn:cloudloom:{key}'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(raw.digest()).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Cloudloom-Key: {'' if key is None else key}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Cloudloom-Refers-To-Key: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without name and time."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def parse_record(data: bytes) -> dict:
    """Headers, payload facts and checks of one record; raises where a digest or length does not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    key, refers = fields.get("Cloudloom-Key", ""), fields.get("Cloudloom-Refers-To-Key", "")
    return {"fields": fields, "payload": payload, "key": int(key) if key else None, "length": length, "digest": digest, "type": fields["WARC-Type"], "refers_to": int(refers) if refers else None}


def records_of(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The members of a gzip stream, one record each, with no more than one record in memory."""
    rest = b""
    while rest := rest or stream.read(chunk):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    raise ValueError("the archive ends inside a record")
            parts.append(member.decompress(rest))
            rest = member.unused_data if member.eof else b""
        yield b"".join(parts)


def _revisits(pages: DataFrame, id_col: str, payload_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Slim facts of all rows (staged), and (key, digest, refers_to) of the rows that repeat a payload."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    slim = staged(pages.select(F.col(id_col).cast("long").alias("key"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"), F.octet_length(payload).cast("long").alias("size")), "warc-slim")
    groups = slim.filter(F.col("size") >= least).groupBy("digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    again = slim.filter(F.col("size") >= least).join(groups.select("digest", "refers_to"), "digest").filter(~F.col("key").eqNullSafe(F.col("refers_to")))
    return slim, again.select("key", "digest", "refers_to").distinct()


def _place(key: Column, digest: Column) -> Column:
    """A key and digest as bytes in their order: a null key first, then the key, then the digest."""
    number = F.unhex(F.lpad(F.hex(F.coalesce(key, F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.when(key.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))), number, digest)


def _shards(slim: DataFrame, shard_bytes: int) -> tuple[Callable[[Column], Column], int]:
    """The shard of a place, and the number of shards.

    Places are range-sorted and their bytes summed up in each range and over the ranges before; a shard begins where the sum
    passes a multiple of ``shard_bytes``. The driver gets the places where shards begin: 29 bytes for each ``shard_bytes`` of payload.
    """
    spark = slim.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = slim.select(_place(F.col("key"), F.col("digest")).alias("place"), (F.col("size") + 512).alias("bytes")).groupBy("place").agg(F.sum("bytes").alias("bytes"))
    cut = staged(staged(places, "warc-places").repartitionByRange(n, "place").sortWithinPartitions("place").withColumn("part", F.spark_partition_id()), "warc-sorted")
    sizes = cut.groupBy("part").agg(F.sum("bytes").alias("sum"))
    ranges = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("part", F.coalesce(F.sum("sum").over(ranges), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.join(F.broadcast(starts), "part").select("place", F.floor((F.col("start") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))) / shard_bytes).alias("shard"))
    begins = summed.groupBy("shard").agg(F.min("place").alias("place")).toArrow()["place"].to_pylist()
    cuts = np.array(sorted(begins), "S29")
    held = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def shard(place: pa.Array) -> pa.Array:
        at = np.searchsorted(held.value, np.array(place.to_pylist(), "S29"), "right") - 1
        return pa.array(np.maximum(at, 0), pa.int32())

    return shard, max(1, len(cuts))


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least_dedup: int = 1000, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` under ``path`` (a URI that the executors share) and return the committed manifest."""
    spark = pages.sparkSession
    if _exists(spark, f"{path}/manifest"):
        raise FileExistsError(f"{path} holds a manifest already")
    slim, again = _revisits(pages, id_col, payload_col, least_dedup)
    shard, n_shards = _shards(slim, shard_bytes)
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.lit(1).alias("kind"), url.alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    marks = again.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "digest", "refers_to")
    placed = rows.unionByName(marks).withColumn("shard", shard(_place(F.col("key"), F.col("digest"))))
    dealt = placed.repartitionById(n_shards, "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "digest", "kind", "url")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        out, done, refers, now = None, [], None, (None, None)

        def close() -> None:
            nonlocal out
            if out:
                out["stream"].close()
                store.move(out["temporary"], f"{root}/{out['file']}")
                done.append([out["file"], *out["row"], out["sha1"].hexdigest(), *out["keys"]])
                out = None

        for batch in batches:
            for row in (r for at, texts in pieces(batch.column("payload")) for r in batch.slice(at, len(texts)).to_pylist()):
                place = (row["key"], row["digest"])
                if place != now:
                    now, refers = place, None
                if row["kind"] == 0:
                    refers = row["refers_to"]
                    continue
                if out and (out["row"][0] != row["shard"] or out["row"][3] >= roll_bytes):
                    number = out["row"][1] + 1 if out["row"][0] == row["shard"] else 0
                    close()
                elif not out:
                    number = 0
                if not out:
                    name = f"part-{row['shard']:06d}-{number:05d}.warc.gz"
                    temporary = f"{root}/_temporary/{uuid.uuid4().hex}-{name}"
                    store.create_dir(f"{root}/_temporary", recursive=True)
                    out = {"file": name, "temporary": temporary, "stream": store.open_output_stream(temporary, compression=None), "row": [row["shard"], number, 0, 0], "sha1": hashlib.sha1(), "keys": [row["key"], None]}
                payload = row["payload"].encode()
                member = gzip_member(make_record(row["key"], row["url"], payload, refers, date))
                out["stream"].write(member)
                out["sha1"].update(member)
                out["row"][2] += 1
                out["row"][3] += len(member)
                out["keys"][1] = row["key"]
        close()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split(" ")[0] for x in MANIFEST_FIELDS.split(", ")]
        yield pa.record_batch([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

    temporary, final = f"{path}/_manifest.{uuid.uuid4().hex}", f"{path}/manifest"
    dealt.mapInArrow(archive, MANIFEST_FIELDS).write.parquet(temporary)
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(temporary), jvm.org.apache.hadoop.fs.Path(final)
    store = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.rename(source, target):
        raise OSError(f"cannot commit {final}")
    store.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_temporary"), True)
    return read_manifest(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_FIELDS).parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives that the manifest of ``path`` lists; every digest and length is checked."""
    manifest = read_manifest(spark, path).select("file", "records")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                n = 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in records_of(stream):
                        r = parse_record(data)
                        rows.append((r["key"], r["fields"]["WARC-Target-URI"], r["length"], r["digest"], r["type"], r["refers_to"]))
                        n += 1
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if n != records:
                    raise ValueError(f"{name} has {n} records; the manifest says {records}")
                yield _batch(rows)

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(parse, "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))
