"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 letters are hashed to a fixed number of buckets. Document frequencies are counted
over all training rows, never a sample. The weights are learned on a bounded sample with
follow-the-regularised-leader updates under elastic-net penalties, which leave most weights at zero;
one temperature, fitted on sampled rows that the weights did not see, calibrates the scores.

Cases: a null text, or one without letters, is ``und`` with score 0; a text of any length counts whole;
ties go to the language that sorts first; repeated rows get equal answers; without training rows all is
``und``; an empty table gives an empty table; the language, source and id of a row are no inputs of its prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import pieces, release

UNKNOWN = "und"
BUCKETS = 1 << 15
LONGEST_GRAM = 3
#: Most sampled rows of each language, and of all languages together, that the weights are fitted on.
ROWS_OF_LANGUAGE, ROWS_IN_ALL = 1200, 40_000
#: Languages that the weights have room for; more labels than that are refused, not left out.
MOST_LANGUAGES = 2048
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of a whole text, and their counts. Runs of other characters count as one blank."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    alpha = letters()[points]
    if not alpha.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.where(alpha, points, 32).astype(np.uint32)
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    counts, h = np.zeros(BUCKETS, np.int64), c * np.uint32(0x9E3779B1)
    for n in range(1, LONGEST_GRAM + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        counts += np.bincount(((h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE3D)) >> np.uint32(17), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets + 1 (bias) by languages
    temperature: float = 1.0

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        return self.weighed(*gram_counts(text))

    def weighed(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Weighted and scaled buckets with the bias; None without any."""
        if not len(at):
            return None
        x = (1.0 + np.log(n)) * self.idf[at]
        x /= math.sqrt(float(x @ x)) or 1.0
        return np.append(at, BUCKETS), np.append(x, 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        got = self.features(text) if self.languages else None
        if got is None:
            return UNKNOWN, 0.0
        p = softmax(got[1] @ self.weights[got[0]] / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 2) -> np.ndarray:
    """Weights by follow-the-regularised-leader: per-coordinate rates, ``l1`` for zeros and ``l2`` against large weights."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def current(at) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = current(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p
            was = n[at]
            now = was + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(was)) / alpha * w
            n[at] = now
    return current(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature from 0.05 to 20 of least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / math.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels]).mean())

    a, b, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of the one text column each bucket occurs, over all rows; a row for each task and bucket is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                for text in texts:
                    seen[gram_counts(text)[0]] += 1
            n += batch.num_rows
        release("langid")
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(seen[at], n), pa.int64())], ["bucket", "n"])

    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS, np.int64)
    rows = 0
    for bucket, n in found:
        if bucket < 0:
            rows = n
        else:
            df[bucket] = n
    return df, rows


def hashed(text: Column) -> Column:
    """A struct (at, n) of the buckets of ``gram_counts`` and their counts, so that no text goes to the driver."""

    @F.arrow_udf("at array<int>, n array<int>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = [gram_counts(t) for _, texts in pieces(batch) for t in texts]
            ends = pa.array(np.cumsum([0, *(len(at) for at, _ in got)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([g[k] for g in got] or [np.empty(0, np.int64)]).astype(np.int32))) for k in (0, 1)]
            yield pa.StructArray.from_arrays(lists, ["at", "n"])
        release("langid")

    return counted(text)


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_of_language: int = ROWS_OF_LANGUAGE, rows_in_all: int = ROWS_IN_ALL) -> Model:
    """Learn from ``training`` alone: frequencies from all of it, weights from at most ``rows_of_language`` rows a language and ``rows_in_all`` together.

    Rows are drawn by a hash of id and text and counted in the order of that hash, so equal tables give equal weights. The driver
    gets the hashed n-grams of the drawn rows: at most ``BUCKETS`` pairs of numbers each, whatever the length of their texts.
    """
    rows = training.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels in {lang_col}: not a column of languages")
    languages = sorted(sizes)
    df, n = document_frequencies(rows.select("text"))
    model = Model(languages, np.log((1.0 + n) / (1.0 + df)) + 1.0, np.zeros((BUCKETS + 1, max(1, len(languages)))))
    if not languages:
        return model
    most = max(1, min(rows_of_language, rows_in_all // len(languages)))
    # a row's hash against a bound by language, a little over the number wanted; repeated rows fall under one hash and count once
    span, draw = 1 << 62, F.pmod(F.xxhash64("id", "text"), F.lit(1 << 62))
    bounds = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(span, int(span * min(1.0, most * 1.1 / sizes[k])))))))
    drawn = rows.select(draw.alias("draw"), "text", "lang").filter(F.col("draw") <= bounds[F.col("lang")]).dropDuplicates(["lang", "draw"])
    got = drawn.select("lang", "draw", hashed(F.col("text")).alias("h")).toArrow()
    texts = got["h"].combine_chunks()
    at, n = (texts.field(k) for k in (0, 1))
    index, taken, feats, late = {k: i for i, k in enumerate(languages)}, dict.fromkeys(languages, 0), [], []
    names = got["lang"].to_pylist()
    for i in sorted(range(got.num_rows), key=list(zip(got["draw"].to_pylist(), names, strict=True)).__getitem__):
        x = model.weighed(at[i].values.to_numpy().astype(np.int64), n[i].values.to_numpy().astype(np.int64))
        if x is not None and taken[names[i]] < most:
            taken[names[i]] += 1
            (late if taken[names[i]] % 5 == 0 else feats).append((x, index[names[i]]))
    del got, texts, at, n
    model.weights = learn([x for x, _ in feats], [k for _, k in feats], len(languages))
    logits = np.array([x[1] @ model.weights[x[0]] for x, _ in late]).reshape(len(late), len(languages))
    model.temperature = temperature(logits, np.array([k for _, k in late], int))
    release("langid")
    return model


def predict(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column (lang_pred, score) for ``df[text_col]``."""
    held = df.sparkSession.sparkContext.broadcast(model)  # buckets by languages, a fixed bound

    @F.arrow_udf("lang_pred string, score double")
    def answered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for batch in batches:
            out = [m.predict(t) for _, texts in pieces(batch) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["lang_pred", "score"])
        release("langid")

    return answered(F.col(text_col).cast("string"))
