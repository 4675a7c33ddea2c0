"""Near-duplicate documents: banded MinHash candidates, odd sketches, and a check on the full shingle sets.

1. One pass over the texts makes slim facts: the number of distinct shingles, a digest of the word
   sequence, the band keys of 112 MinHash samples (28 bands of 4), and an odd sketch: a 1024-bit
   parity bitmap into which the samples are folded. Equal word sequences are one node from here on.
2. Every band bucket links its members to that of its smallest id. Pairs whose sketches differ in too many
   bits (the XOR's population count gives the similarity) are dropped: the cut lies over six
   standard errors below the threshold. So are pairs which the parity bitmaps of the whole sets rule out. The
   rest are confirmed on the full sets.
3. Links found make components. Members of a bucket that are in different components are compared too:
   all such pairs in buckets of at most ``PAIRED`` members; in larger ones by a prefix filter, which is exact: two sets
   this similar share one of their rarest shingles. Then components again.

So a large group of copies costs a star and no pairs, and no link between components is passed over. A pair at the threshold shares
no bucket with probability (1 - 0.8^4)^28 = 4e-7.

The full check sends each hub's text once for a salted group of at most about ``MEMBERS`` others, so no task holds a
hub's whole group, and a stream of sorted rows holds one hub at a time.

Nodes are the distinct word sequences, numbered when they are written. A node's text is found again by the id of its smallest row
and a hash of that row's text, so ids may be of any simple type and may repeat.

Cases: null and empty texts, and texts of white space, have no shingles and no links; a text with fewer words than a
shingle is one shingle; a text of any length is taken whole; repeated rows and equal texts share a component;
rows that share an id are told apart by their texts; a row without an id takes no part and is kept (``deduplicated`` compares it, too); an empty table gives an empty
table; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import kept, mix64, odd_constants, pieces, staged, tables
from cloudloom.llm.graph import components

BANDS, ROWS = 28, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: Standard errors of the sketch's similarity that the cut lies below the threshold.
ERRORS = 6.5
PAIRED, MEMBERS, POSTED = 24, 128, 512
#: Bits of the map of wanted texts for each of them, and at least and at most in all (32 MB). With more texts than that can tell apart there is no map.
MARKED, LEAST_MARKS, MOST_MARKS = 16, 1 << 20, 1 << 28
_MULTIPLIERS = odd_constants(SAMPLES, 1)
_PLACES = odd_constants(SAMPLES, 2)
_WORD_MULTIPLIERS = odd_constants(64, 3)


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 60_000:
                self.clear()
            self[word] = value
        return value


_words = kept("neardup", _Words())


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(ws: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of the whole sequence where it is shorter."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, ws), np.uint64, len(ws))
    size_here = min(size, len(ws))
    total = np.zeros(len(ws) - size_here + 1, np.uint64)
    for i in range(size_here):
        total += mix64(h[i : i + len(total)] + np.uint64(i)) * _WORD_MULTIPLIERS[i % 64]
    return np.unique(mix64(total + np.uint64(size_here)))


def minhashes(s: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        least = np.minimum(least, (s[i : i + 1024, None] * _MULTIPLIERS).min(0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = mix64(least).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples as 64-bit words: each flips the bit its place and value hash to."""
    bits = mix64(least * np.uint64(3) + _PLACES) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """The odd sketch of a whole set. The XOR of two never has more bits than the sets have elements in one alone, so it rules pairs out for certain."""
    odd = (np.bincount((s % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def most_differing_bits(threshold: float) -> int:
    """The XOR population count beyond which a pair is dropped."""
    least = threshold - ERRORS * (threshold * (1 - threshold) / SAMPLES) ** 0.5
    differing = 2 * SAMPLES * (1 - least)
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * differing / SKETCH_BITS)) + 3 * (SKETCH_BITS / 4) ** 0.5 * 0.5)


def _facts(docs: DataFrame, size: int) -> DataFrame:
    """(id, hash, n_shingles, digest, bands, sketch, parity) of each row of ``docs`` (id, hash, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tables("neardup"):
            for batch in batches:
                for at, texts in pieces(batch.column(2)):
                    piece = batch.slice(at, len(texts))
                    counts, digests, bands, sketches, parities = [], [], [], [], []
                    for text in texts:
                        ws = words(text)
                        s = shingles(ws, size)
                        counts.append(len(s))
                        if len(s):
                            least = minhashes(s)
                            digests.append(xxhash.xxh3_128_digest(b" ".join(ws)))
                            bands.append(band_keys(least))
                            sketches.append(odd_sketch(least))
                            parities.append(parity(s))
                        else:
                            digests.append(None)
                            bands.append(None)
                            sketches.append(None)
                            parities.append(None)
                    longs = pa.list_(pa.int64())
                    yield pa.record_batch([piece.column(0), piece.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs), pa.array(parities, longs)], ["id", "hash", "n_shingles", "digest", "bands", "sketch", "parity"])

    return docs.mapInArrow(make, f"id {docs.schema['id'].dataType.simpleString()}, hash long, n_shingles long, digest binary, bands array<long>, sketch array<long>, parity array<long>")


def _places(hashes: np.ndarray, marks: int) -> np.ndarray:
    return (mix64(hashes.astype(np.int64).view(np.uint64) + np.uint64(77)) % np.uint64(marks)).astype(np.int64)


def marker(wanted: DataFrame) -> Column | None:
    """Whether a row's ``hash`` may be one of ``wanted``'s: true for all that are, and for few others, so that a join needn't move every text.

    The hashes set bits of a map whose size follows their number. None beyond what the largest map can tell apart.
    """
    slim = wanted.select("hash").distinct()
    n = slim.count()
    marks = max(LEAST_MARKS, 1 << (MARKED * max(1, n) - 1).bit_length())
    if marks > MOST_MARKS:
        return None

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(marks // 64, np.uint64)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(zero_copy_only=False), marks)
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(bits)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(bits[at].view(np.int64))], ["word", "bits"])

    words_ = slim.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(marks // 64, np.int64)
    bits[words_["word"].to_numpy(np.int64)] = words_["bits"].to_numpy(np.int64)
    held = wanted.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    @F.arrow_udf("boolean")
    def marked(hashes: pa.Array) -> pa.Array:
        at = _places(hashes.to_numpy(zero_copy_only=False), marks)
        return pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return marked(F.col("hash"))


def _with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (id, hash, ...) with the ``text`` of the document they name."""
    near = marker(rows)
    texts = (docs if near is None else docs.filter(near)).select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), "text")
    return rows.join(texts, (F.col("hash") == F.col("__hash")) & F.col("id").eqNullSafe(F.col("__id"))).drop("__id", "__hash")


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (hub, member, and the id and hash of each) whose full shingle sets have 100 * intersection >= ``percent`` * union, as (a, b)."""
    degrees = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    routed = pairs.join(degrees, "hub").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    side = lambda name, kind: routed.select("hub", "part", F.lit(kind).alias("kind"), F.col(name).alias("node"), F.col(f"id_{name}").alias("id"), F.col(f"h_{name}").alias("hash"))
    routes = side("hub", 0).distinct().unionByName(side("member", 1))
    rows = _with_texts(routes, docs).select("hub", "part", "kind", "node", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of_hub = None, None
        with tables("neardup"):
            for batch in batches:
                found: list[tuple[int, int]] = []
                hubs, parts, kinds, nodes = (c.to_pylist() for c in batch.columns[:4])
                for at, texts in pieces(batch.column(4)):
                    for hub, part, kind, node, text in zip(hubs[at:], parts[at:], kinds[at:], nodes[at:], texts, strict=False):
                        s = shingles(words(text), size)
                        if (hub, part) != now:
                            now, of_hub = (hub, part), None
                        if kind == 0:
                            of_hub = s
                        elif of_hub is not None and min(len(s), len(of_hub)) * 100 >= percent * max(len(s), len(of_hub)):
                            common = len(np.intersect1d(s, of_hub, assume_unique=True))
                            if common and 100 * common >= percent * (len(s) + len(of_hub) - common):
                                found.append((hub, node))
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (hub, member) whose set sizes and sketches allow the threshold, with the id and hash of each side."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("id").alias(f"id_{name}"), F.col("hash").alias(f"h_{name}"), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"), F.col("parity").alias(f"p_{name}"))
    both = pairs.join(side("hub"), "hub").join(side("member"), "member")
    bits = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    differing = bits("s_hub", "s_member")
    possible = bits("p_hub", "p_member") * (100 + percent) <= (F.col("n_hub") + F.col("n_member")) * (100 - percent)
    sizes = F.least("n_hub", "n_member") * 100 >= F.greatest("n_hub", "n_member") * percent
    return both.filter(sizes & possible & (differing <= most_differing_bits(percent / 100))).select("hub", "member", "id_hub", "h_hub", "id_member", "h_member")


def _prefix_pairs(crowd: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (hub, member) of nodes of ``crowd`` (node, component) in different components that may reach the threshold.

    Exact: with the shingles of each set in one order, rarest first, two sets with Jaccard similarity t share one of the
    first n - ceil(t n) + 1 of either, and the first they share leaves enough behind it for the overlap that t needs.
    The nodes of one shingle are compared in blocks of at most about ``POSTED``, by their parity bitmaps; only pairs
    that these leave possible become rows.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tables("neardup"):
            for batch in batches:
                keys, components_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at, texts in pieces(batch.column(2)):
                    for i, text in enumerate(texts, at):
                        s = shingles(words(text), size).view(np.int64)
                        yield pa.record_batch([pa.array(np.full(len(s), keys[i]), pa.int64()), pa.array(np.full(len(s), components_[i]), pa.int64()), pa.array(s), pa.array(np.full(len(s), len(s)), pa.int64())], ["id", "component", "shingle", "n"])

    named = crowd.join(nodes.select("node", "id", "hash"), "node")
    each = staged(_with_texts(named, docs).select("node", "component", "text").mapInArrow(spread, "id long, component long, shingle long, n long").distinct(), "crowd")
    # tables of their own, so that a join with them can split a shingle that very many sets hold
    common = staged(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1"), "common")
    # shingles of one set alone come first in the order and can't meet: they only use up the prefix
    ranked = each.join(common, "shingle", "left").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("seen", F.lit(1)), "shingle")))
    prefix = ranked.filter((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & F.col("seen").isNotNull()).select("shingle", "id", "component", "n", "place")
    prefix = staged(prefix.join(nodes.select(F.col("node").alias("id"), "parity"), "id"), "prefix")
    crowds = staged(prefix.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / POSTED).cast("int").alias("more")).filter("more > 1"), "crowds")
    own = F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")).cast("int")
    dealt = prefix.join(crowds, "shingle", "left").withColumn("parts", F.coalesce("more", F.lit(1))).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")
    dealt = dealt.select("shingle", "id", "component", "n", "place", "parity", "own", other).select("shingle", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "id", "component", "n", "place", "parity")
    dealt = dealt.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def pairs() -> pa.RecordBatch:
            key, component, n, place, part = (np.array([r[k] for r in held], np.int64) for k in (4, 5, 6, 7, 3))
            marks = np.array([r[8] for r in held], np.int64)
            out: list[np.ndarray] = []
            for at in range(len(held) - 1):
                to = slice(at + 1, None)
                both = n[at] + n[to]
                ok = (component[to] != component[at]) & (key[to] != key[at]) & (np.minimum(n[at], n[to]) * 100 >= np.maximum(n[at], n[to]) * percent)
                ok &= (np.minimum(n[at] - place[at], n[to] - place[to]) + 1) * (100 + percent) >= both * percent
                if now[1] != now[2]:
                    ok &= part[to] != part[at]
                if len(hit := np.flatnonzero(ok)):
                    differing = np.bitwise_count((marks[to][hit] ^ marks[at]).view(np.uint64)).sum(1, dtype=np.int64)
                    hit = hit[differing * (100 + percent) <= both[hit] * (100 - percent)]
                    out.append(np.stack([np.full(len(hit), key[at]), key[to][hit]], 1))
            found = np.concatenate(out) if out else np.empty((0, 2), np.int64)
            return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["hub", "member"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != now:
                    if len(held) > 1:
                        yield pairs()
                    held, now = [], r[:3]
                held.append(r)
        if len(held) > 1:
            yield pairs()

    return dealt.mapInArrow(compare, "hub long, member long").select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member")).distinct()


def _groups(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The facts of each row of ``docs`` (id, hash, text), and (digest, component, id, hash, component_id, component_hash) of each distinct word sequence."""
    facts = staged(_facts(docs, size), "facts")
    least = F.min(F.struct("id", "hash")).alias("row")
    made = facts.filter("digest is not null").groupBy("digest").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    nodes = staged(made.select(F.monotonically_increasing_id().alias("node"), "digest", "row.id", "row.hash", "n_shingles", "bands", "sketch", "parity"), "nodes")
    entries = nodes.select("node", "id", F.explode("bands").alias("bucket"))
    # copies follow what they are made from, so the row of the smallest id is the likeliest middle of a group
    buckets = entries.groupBy("bucket").agg(F.coalesce(F.min_by("node", "id"), F.min("node")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = staged(entries.select("node", "bucket").join(buckets, "bucket"), "crowded")
    stars = staged(_likely(crowded.filter("node <> hub").select("hub", F.col("node").alias("member")).distinct(), nodes, percent), "stars")
    first = staged(components(confirm(stars, docs, size, percent)), "first")

    # buckets whose members are not all in one component yet
    placed = crowded.join(first, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    open_ = staged(placed.join(mixed, "bucket"), "open")
    small = open_.filter(F.col("n") <= PAIRED)
    other = small.select("bucket", F.col("node").alias("member"), F.col("component").alias("c2"))
    pairs = small.select("bucket", F.col("node").alias("hub"), "component").join(other, "bucket").filter((F.col("hub") < F.col("member")) & (F.col("component") != F.col("c2"))).select("hub", "member").distinct()
    crowd = open_.filter(F.col("n") > PAIRED).select("node", "component").distinct()
    if not crowd.isEmpty():
        pairs = pairs.unionByName(_prefix_pairs(crowd, nodes, docs, size, percent)).distinct()
    more = staged(_likely(pairs.join(stars.select("hub", "member"), ["hub", "member"], "left_anti"), nodes, percent), "more")
    if not more.isEmpty():
        # what is joined already goes in as stars, so the rounds start where the first ones ended
        joined = first.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        first = staged(components(joined.unionByName(confirm(more, docs, size, percent))), "second")

    labelled = nodes.select("digest", "id", "hash", "node").join(first, "node", "left").select("digest", "id", "hash", F.coalesce("component", "node").alias("component"))
    least_of = labelled.groupBy("component").agg(least).select("component", F.col("row.id").alias("component_id"), F.col("row.hash").alias("component_hash"))
    return facts, labelled.join(least_of, "component")


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the component's smallest id is the one kept."""
    docs = _named(df, id_col, text_col)
    known = docs.filter("id is not null")
    facts, groups = _groups(known, size, percent)
    out = facts.select("id", "n_shingles", "digest").join(groups.select("digest", "component_id"), "digest", "left")
    component = F.coalesce("component_id", "id")
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (component == F.col("id")).alias("kept"))
    nameless = _facts(docs.filter("id is null"), size).select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``df`` for each group of near copies: that of the smallest id. Rows without words are kept, all of them.

    Rows are told apart by id and text, so of rows that share an id only the copies go, and of repeated rows one stays. A row without an
    id is compared like any other and is the smallest of its group.
    """
    facts, groups = _groups(_named(df, id_col, text_col), size, percent)
    rows = facts.filter("digest is not null").groupBy("digest", "id", "hash").agg(F.count(F.lit(1)).alias("n"))
    of = rows.join(groups.select("digest", "component_id", "component_hash"), "digest")
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("hash") == F.col("component_hash"))
    marked = staged(of.filter(~stays | (F.col("n") > 1)).select(F.col("id").alias("k_id"), F.col("hash").alias("k_hash"), stays.alias("stays")), "marked")
    same = F.col("__id").eqNullSafe(F.col("k_id")) & (F.col("__hash") == F.col("k_hash"))
    # the hash goes by the name that the marker reads, in a struct, so that no column of the table can clash with it
    keyed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash")).withColumn("__hash", F.col("hash"))
    near = marker(marked.select(F.col("k_hash").alias("hash")))
    maybe = keyed if near is None else keyed.filter(near)
    out = maybe.join(marked, same, "left_anti").select("row")
    if near is not None:
        out = keyed.filter(~near).select("row").unionByName(out)
    again = marked.filter("stays")
    if not again.isEmpty():
        out = out.unionByName(maybe.join(again, same, "left_semi").dropDuplicates(["__id", "__hash"]).select("row"))
    return out.select("row.*")
