"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Test items are cut into word n-grams. One pass counts in how many documents each occurs. All n-grams of an item are
seeds but its common ones: those in more than ``COMMON_SHARE`` of the documents and in over ``COMMON_TIMES`` as
many as the item's median n-gram. So an item keeps at least half of its n-grams, an item that a third of the corpus copies keeps
them all, and nothing else depends on the size of the corpus. A second pass looks up every n-gram of every whole document
among the seeds, aligns the item with the stretch around the hits, and reports alignments whose score is at least ``least`` of
the item's score with itself, or that of ``LONG`` words in a row. Copies with words changed, left out or put in align too.

Both passes are narrow: no text is shuffled. Items go to the executors in blocks of at most about ``BLOCK_BYTES`` of text, one
block after the other, each with its own two passes, so memory doesn't grow with the benchmark. Both passes take the
documents in pieces of about ``PIECE_BYTES``, whose n-grams are looked up at once; words are cut by blanking what is no
part of one, at half the cost of a regular expression.

Cases: null and empty documents match nothing; a document of any length is searched whole; null and wordless items are
left out; an item shorter than a seed matches by its whole word sequence; equal items and repeated documents each give
their rows; ids may be of any simple type, and null; of equally good alignments in a document the first is reported; empty tables give no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from cloudloom.llm.common import kept, mix64, pieces, release, staged

SEED = 4
#: An n-gram is common if it is in more than this share of the documents, and in more than so many times as many as its item's median n-gram.
COMMON_SHARE, COMMON_TIMES = 0.02, 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's own score that an alignment needs, and words in a row whose score is enough for an item of any length.
LEAST, LONG = 0.5, 25
BLOCK_BYTES = 16 << 20
PIECE_BYTES = 1 << 19
_WORD = re.compile(r"\w+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 32:
            if len(self) >= 60_000:
                self.clear()
            self[word] = value
        return value


_hashes = kept("licenses", _Hashes())


def word_hashes(text: str | None) -> np.ndarray:
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    total = np.full(max(0, len(h) - size + 1), np.uint64(size))
    for i in range(size):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(total)])
    return total


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, itself if it can be part of a word, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for run in _WORD.finditer("".join(map(chr, range(len(out))))):
        out[run.start() : run.end()] = np.arange(run.start(), run.end())
    return out


def words_of(text: str | None) -> list[str]:
    """The lower-cased words, as ``_WORD`` finds them."""
    if not text:
        return []
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return _letters()[points].tobytes().decode("utf-32-le").split()


class Vocabulary(dict):
    """Numbers, from 1, of the words of a block of items; a document's other words are 0 and match nothing."""

    def add(self, text: str) -> np.ndarray:
        return np.array([self.setdefault(w, len(self) + 1) for w in words_of(text)], np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, with a 0 behind each text, so that no run of known words goes on in the next; and where each text begins, and the last ends."""
        parts, begins = [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            found = words_of(text)
            found.append("")  # no word
            parts.append(np.fromiter(map(self.get, found, repeat(0)), np.int64, len(found)))
            begins[i + 1] = len(found)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum(begins)


def known_grams(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of ``size`` known words, and their hashes."""
    known = v > 0
    whole = known[: max(0, len(v) - size + 1)].copy()
    for i in range(1, size):
        whole &= known[i : i + len(whole)]
    at = np.flatnonzero(whole)
    total = np.full(len(at), np.uint64(size))
    for i in range(size if len(at) else 0):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + v[at + i].astype(np.uint64))
    return at, total


def looked_up(v: np.ndarray, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of ``size`` known words that are among the sorted ``keys``, and which keys they are."""
    places, g = known_grams(v, size)
    if not len(g) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(keys, g)
    at[at == len(keys)] = 0
    same = keys[at] == g
    return places[same], at[same]


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of two word sequences, and where it begins and ends in ``stretch``. Linear gaps; rows are filled at once by a running maximum."""
    n = len(stretch)
    steps = np.arange(n + 1) * -GAP
    above, above_from = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(stretch == word, MATCH, MISMATCH)
        down = above[1:] + GAP
        score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        up = diagonal >= down
        cell, source = np.where(up, diagonal, down), np.where(up, above_from[:-1], above_from[1:])
        live = cell > 0
        score[1:][live], origin[1:][live] = cell[live], source[live]
        run = score + steps  # a gap in the item costs one step to the right
        top = np.maximum.accumulate(run)
        leader = np.maximum.accumulate(np.where(run == top, np.arange(n + 1), 0))
        score = top - steps
        origin = np.where(score > 0, origin[leader], np.arange(n + 1))
        at = int(np.argmax(score))
        if score[at] > best[0]:
            best = (int(score[at]), int(origin[at]), at)
        above, above_from = score, origin
    return best


@dataclass
class Index:
    """Items of one block and their seeds, by seed length."""

    vocabulary: Vocabulary
    ids: list
    items: list[np.ndarray]
    keys: dict[int, np.ndarray]  # size -> sorted seed hashes
    places: dict[int, list[list[tuple[int, int]]]]  # size -> per seed, (item, offset)

    def hits(self, v: np.ndarray, begins: np.ndarray) -> dict[int, dict[int, list[int]]]:
        """For each text with seeds and each item met there, the begins in the text that the seeds stand for."""
        found: dict[int, dict[int, list[int]]] = {}
        for size, keys in self.keys.items():
            places, at = looked_up(v, size, keys)
            texts = np.searchsorted(begins, places, "right") - 1
            for text, place, key in zip(texts.tolist(), (places - begins[texts]).tolist(), at.tolist(), strict=True):
                for item, offset in self.places[size][key]:
                    found.setdefault(text, {}).setdefault(item, []).append(place - offset)
        return found

    def matches(self, texts: list[str | None], least: float) -> list[list[tuple]]:
        """For each text, (item, score share, first word, word after the last) of every item that it holds."""
        v, begins = self.vocabulary.encode(texts)
        out: list[list[tuple]] = [[] for _ in texts]
        for text, hits in self.hits(v, begins).items():
            out[text] = self._aligned(v[begins[text] : begins[text + 1] - 1], hits, least)
        return out

    def _aligned(self, h: np.ndarray, hits: dict[int, list[int]], least: float) -> list[tuple]:
        out = []
        for item, begins in sorted(hits.items()):
            words = self.items[item]
            n, best = len(words), (0, 0, 0)
            own = MATCH * n
            need = min(least * own, MATCH * LONG)
            begins = np.unique(begins)
            for group in np.split(begins, np.flatnonzero(np.diff(begins) > 2 * n) + 1):
                a, b = max(0, int(group[0]) - n), min(len(h), int(group[-1]) + 2 * n)
                for c in range(a, b, 8 * n):  # long stretches go in parts that overlap by what an alignment can span
                    part = h[c : min(b, c + 12 * n)]
                    if MATCH * int(np.isin(words, part).sum()) < max(need, best[0] + 1):
                        continue
                    score, begin, end = align(words, part)
                    if score > best[0]:
                        best = (score, c + begin, c + end)
            if best[0] and best[0] >= need:
                out.append((self.ids[item], best[0] / own, best[1], best[2]))
        return out


def _all_grams(items: list[np.ndarray]) -> dict[int, list[tuple[np.ndarray, int]]]:
    by: dict[int, list] = {}
    for i, h in enumerate(items):
        size = min(SEED, len(h))
        by.setdefault(size, []).append((known_grams(h, size)[1], i))
    return by


def _frequencies(docs: DataFrame, text_col: str, vocabulary: Vocabulary, keys: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], int]:
    """Documents that each item n-gram is in, and documents in all. A row for each task and n-gram met is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mine = held.value
        seen, n = {s: np.zeros(len(k), np.int64) for s, k in mine.items()}, 0
        for batch in batches:
            n += batch.num_rows
            for _, texts in pieces(batch.column(0), most_bytes=PIECE_BYTES):
                v, begins = known.encode(texts)
                for size, k in mine.items():
                    places, at = looked_up(v, size, k)
                    if len(at):
                        in_text = np.unique((np.searchsorted(begins, places, "right") - 1) * len(k) + at)  # once a text
                        np.add.at(seen[size], in_text % len(k), 1)
        release("decontaminate")
        rows = [(-1, 0, n)] + [(s, int(i), int(v[i])) for s, v in seen.items() for i in np.flatnonzero(v)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["size", "at", "n"])

    total, out = 0, {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
    for size, at, n in docs.select(F.col(text_col).cast("string")).mapInArrow(count, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).collect():
        if size < 0:
            total = n
        else:
            out[size][at] = n
    return out, total


def _index(rows: list, docs: DataFrame, text_col: str) -> Index:
    vocabulary = Vocabulary()
    items = [(r["id"], h) for r in rows if len(h := vocabulary.add(r["text"]))]
    ids, words = [i for i, _ in items], [h for _, h in items]
    by = _all_grams(words)
    keys = {s: np.unique(np.concatenate([g for g, _ in x])) for s, x in by.items()}
    seen, total = _frequencies(docs, text_col, vocabulary, keys)
    chosen: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for size, x in by.items():
        for g, item in x:
            n = seen[size][np.searchsorted(keys[size], g)]
            seeds = np.flatnonzero((n <= COMMON_SHARE * total) | (n <= COMMON_TIMES * max(1.0, float(np.median(n))))).tolist()
            for at in seeds:
                chosen.setdefault(size, {}).setdefault(int(g[at]), []).append((item, at))
    return Index(vocabulary, ids, words, {s: np.array(sorted(c), np.uint64) for s, c in chosen.items()}, {s: [c[k] for k in sorted(c)] for s, c in chosen.items()})


def _matched(held, least: float, id_type: DataType) -> Callable[[Column], Column]:
    names = ("item_id", "score", "first_word", "end_word")

    @F.arrow_udf(f"array<struct<item_id:{id_type.simpleString()},score:double,first_word:long,end_word:long>>")
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = held.value
        kind = pa.list_(pa.struct(list(zip(names, (to_arrow_type(id_type), pa.float64(), pa.int64(), pa.int64()), strict=True))))
        for batch in batches:
            yield pa.array([[dict(zip(names, m, strict=True)) for m in found] for _, texts in pieces(batch, most_bytes=PIECE_BYTES) for found in index.matches(texts, least)], kind)
        release("decontaminate")

    return matched


def _blocks(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, least: float, block_bytes: int) -> Iterator[Callable[[Column], Column]]:
    """For each block of items, what finds those of its items that a text holds."""
    known = items.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        rows = (known.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else known).orderBy("id", "text").collect()
        yield _matched(docs.sparkSession.sparkContext.broadcast(_index(rows, docs, text_col)), least, known.schema["id"].dataType)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, score, first_word, end_word) of every document and item that align."""
    out = None
    for matched in _blocks(docs, items, text_col, item_id, item_text, least, block_bytes):
        hits = docs.select(F.col(id_col).alias("__id"), matched(F.col(text_col).cast("string")).alias("__hits"))
        # no filter before: it would be pushed down and run the matching twice
        found = hits.select("__id", F.explode("__hits").alias("__hit")).select(F.col("__id").alias(id_col), "__hit.*")
        out = found if out is None else out.union(found)
    if out is None:
        kind = items.schema[item_id].dataType.simpleString()
        return docs.filter(F.lit(False)).select(F.col(id_col), F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("end_word"))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no test item, columns as they are. Between two blocks of items the rows that are left are written and read again."""
    for b, matched in enumerate(_blocks(docs, items, text_col, item_id, item_text, least, block_bytes)):
        docs = staged(docs, "clean") if b else docs
        docs = docs.filter(F.size(matched(F.col(text_col).cast("string"))) == 0)
    return docs
