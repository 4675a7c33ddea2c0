"""Packing by power-of-two decomposition: no sequence holds tokens of two documents, and none is padded.

A document of n tokens (its end token included) is cut into whole pieces of the longest length and
then one piece for each set bit of the rest, longest first. Each piece is a sequence of its own; equal
lengths form a bucket, so that a trainer draws batches of one length. ``sequence_id`` is bucket-major:
the power of two in the top bits, then the input partition, then a running number, so it needs no
count over the corpus and a task that runs again gives the same numbers.

Cases: a null or empty text has the end token alone; a text of any length is cut whole; repeated rows
give pieces with sequence ids of their own; an empty table gives an empty table; a null id stays null.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloudloom.llm.bpe import SPACE, WordTable, byte_letters, require_plain
from cloudloom.llm.common import give_back, pieces

#: Bits of a sequence id below the power of two: the input partition, and the number in it.
PARTITION_BITS, NUMBER_BITS = 24, 34


#: Texts by which the quick merger is held against the tokenizers library when it is loaded.
PROBES = ("It's 10 o'clock,  dann gehen wir\n\n zur Schule\t...", "a b\u3000c \u00e9\u00df\u4e2d\u6587 x\u0301", " " * 9 + "1234567890'll 'LL\r\n", "\x00\x7f\u2028 <|x|>")


#: ``bpe.PRETOKEN`` with runs that give nothing back, which cuts alike and is quicker.
QUICK_PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Letters of a text that are merged at once, and of a run of white space from which the library merges it, as the pattern's memory of it may not hold.
PART, LONG_RUN = 1 << 20, 1 << 14
#: A place where the pre-tokeniser always cuts, and a long run.
_CUT, _RUN = re.compile(f"(?<=[^{SPACE}])[{SPACE}]"), re.compile(f"(?<![{SPACE}])[{SPACE}]{{{LONG_RUN}}}")


class ChunkEncoder:
    """Identifiers of a text as little-endian 32-bit bytes.

    Whole texts, or their parts of about ``PART`` letters, are merged by tiktoken over the same vocabulary where its identifiers are in the order of its
    merges, as ranks need, and the probes agree; otherwise by the tokenizers library itself, kept by word.
    """

    def __init__(self, path: str, cached: int = 100_000):
        import os

        with open(path, encoding="utf-8") as f:
            require_plain(json.load(f), path)

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._ids = ranked(path)
        if self._ids and any(self._ids(t) != self._by_library(t) for t in PROBES):
            self._ids = None
        self._table = WordTable("packing", self._of_chunk, b"".join, cached)
        give_back()  # what reading the file has taken

    def _by_library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _of_chunk(self, chunk: str) -> bytes:
        return array("I", self._by_library(chunk)).tobytes()

    def _plain(self, text: str) -> bytes:
        if self._ids is None:
            return self._table.of_text(text)
        return b"".join(array("I", (self._by_library if len(t) >= LONG_RUN and _RUN.search(t) else self._ids)(t)).tobytes() for t in parts(text))

    def encode(self, text: str) -> bytes:
        if found := [s for s in self.specials if s in text]:
            if len(found) > 1:  # overlapping special strings: the library decides
                return array("I", self._by_library(text)).tobytes()
            return self.specials[found[0]].join(map(self._plain, text.split(found[0])))
        return self._plain(text)


def parts(text: str) -> Iterator[str]:
    """``text`` in parts of at least ``PART`` letters, each up to white space behind a word."""
    at = 0
    while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def ranked(path: str):
    """tiktoken's merger over a byte-level vocabulary file; None where its identifiers don't rank its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    pairs = [m if not isinstance(m, str) else m.split(" ") for m in spec["model"]["merges"]]
    places = [vocab.get("".join(m)) for m in pairs]
    if spec["normalizer"] or None in places or places != sorted(places) or len(vocab.keys() - special) != 256 + len(pairs) or (pairs and places[0] < 256):
        return None
    letter = {v: k for k, v in byte_letters().items()}
    ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("ranked", pat_str=QUICK_PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def binary_lengths(n: int, longest: int) -> list[int]:
    """Piece lengths of ``n`` tokens: whole ``longest`` ones, then the binary digits of the rest from the top."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """A row per piece: id, start, length, crc of its ids, tokens of its document, sequence, offset, bucket and (``with_ids``) the ids.

    One narrow pass, no shuffle. ``longest`` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    id_type = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the encoder's tables stay for the next task, whose words are mostly the same: at most 200,000 short words, and none where whole texts are merged
        yield from cut_with(encoder(vocabulary), batches)

    def cut_with(enc: ChunkEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        partition, numbers = TaskContext.get().partitionId(), [0] * 64
        for batch in batches:
            ids: list[list] = [[] for _ in range(8)]
            payload: list[bytes] = []

            def full() -> pa.RecordBatch:
                arrays = [pa.array(ids[0], arrow_id), *(pa.array(x, pa.int64()) for x in ids[1:8])]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
                if with_ids:
                    ends = np.cumsum([0, *map(len, payload)]) // 4
                    values = pa.array(np.frombuffer(b"".join(payload), "<u4").astype(np.int32), pa.int32())
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
                    names.append("ids")
                for x in ids:
                    x.clear()
                payload.clear()
                return pa.record_batch(arrays, names)

            held = 0
            keys = batch.column(0).to_pylist()
            for key, text in ((keys[at + i], t) for at, texts in pieces(batch.column(1)) for i, t in enumerate(texts)):
                tokens = enc.encode(text or "") + end
                n, start = len(tokens) // 4, 0
                for length in binary_lengths(n, longest):
                    piece, power = tokens[4 * start : 4 * (start + length)], length.bit_length() - 1
                    row = (key, start, length, zlib.crc32(piece), n, power << (PARTITION_BITS + NUMBER_BITS) | partition << NUMBER_BITS | numbers[power], 0, length)
                    numbers[power] += 1
                    for x, value in zip(ids, row, strict=True):
                        x.append(value)
                    if with_ids:
                        payload.append(piece)
                    start += length
                held += len(tokens)
                if held > 2 << 20:
                    yield full()
                    held = 0
            yield full()

    fields = f"`{id_col}` {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket long"
    slim = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(cut, fields + (", ids array<int>" if with_ids else ""))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences with a folder for each length, so that a reader of one length opens no other file."""
    packed.write.partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_buckets`` wrote, with the columns of ``schema``; a filter on ``bucket`` picks folders."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)
