"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text and their first 4, 5 and 6 letters, hashed. A linear weight is
learned for each term with follow-the-regularised-leader updates, so most are zero; every term that enough
rows have shown gets a factor vector, whatever its linear weight, and the product of two terms' vectors
is the weight of their meeting, such as an insult with the mention of a group. The sum over all pairs is
divided by the number of terms (each row's terms are scaled to unit length), or long texts would drown in it.
Penalties hold the margins near the intercept; a slope and an offset, fitted on margins of training rows under machines
that did not see them, make probabilities of them.

Cases: a null or empty text scores by the intercept alone; a text of any length counts whole; ties and
repeated rows get equal scores; labels that disagree on an id count as the higher; without labels all
score 0; an empty table gives an empty table; labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import kept, pieces, release, tables

BUCKETS = 1 << 18
FACTORS = 4
PREFIXES = (4, 5, 6)
#: Most sampled rows of each label that the machine is fitted on.
ROWS_OF_LABEL = (5000, 3000)
#: Parts of the sample; each is scored by a machine learned on the others, and the scores calibrate the final one.
FOLDS = 3
_WORD = re.compile(r"\w+")


class Terms(dict):
    """Buckets of a word's terms, kept for short words; emptied when full."""

    def __init__(self, most: int = 60_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> tuple[int, ...]:
        terms = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]
        value = tuple({(zlib.crc32(t.encode("utf-8", "surrogatepass")) * 0x9E3779B1 >> 7) % BUCKETS for t in terms})
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 48:
            self[word] = value
        return value


_terms = kept("toxicity", Terms())


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a whole text."""
    found: set[int] = set()
    for t in map(_terms.__getitem__, set(_WORD.findall((text or "").lower()))):
        found.update(t)
    return np.sort(np.fromiter(found, np.int64, len(found)))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, at: np.ndarray) -> float:
        v = self.factors[at]
        s = v.sum(0)
        return self.bias + float(self.weights[at].sum()) + 0.5 / max(1, len(at)) * float(s @ s - (v * v).sum())

    def score(self, text: str | None) -> float:
        return sigmoid(self.slope * self.margin(terms(text)) + self.offset)


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def learn(rows: list[np.ndarray], labels: list[int], alpha: float = 0.3, l1: float = 9.0, l2: float = 1.0, factor_rate: float = 0.02, factor_l2: float = 0.01, least_seen: int = 8, epochs: int = 5) -> Machine:
    """Fit by passes over the rows: leader updates for linear weights, adaptive gradient steps for the factors of terms seen often enough."""
    z, n, w = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    v, nv = np.zeros((BUCKETS, FACTORS)), np.full((BUCKETS, FACTORS), 1e-4)
    seen = np.zeros(BUCKETS, np.int64)
    for at in rows:
        seen[at] += 1
    order = np.random.default_rng(11)
    started = np.zeros(BUCKETS, bool)
    prior = min(max(sum(labels) / max(1, len(labels)), 1e-3), 1 - 1e-3)
    bias, bias_n = math.log(prior / (1 - prior)), 1.0
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            wa = w[at]
            used = at[seen[at] >= least_seen]
            new = used[~started[used]]
            if len(new):
                v[new] = order.normal(0, 0.02, (len(new), FACTORS))
                started[new] = True
            va = v[used]
            s = va.sum(0)
            share = 1 / max(1, len(at))
            g = sigmoid(bias + wa.sum() + 0.5 * share * (s @ s - (va * va).sum())) - labels[i]
            bias_n += g * g
            bias -= 0.1 * g / math.sqrt(bias_n)
            was = n[at]
            now = was + g * g
            za = z[at] + g - (np.sqrt(now) - np.sqrt(was)) / alpha * wa
            z[at], n[at] = za, now
            w[at] = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((1.0 + np.sqrt(now)) / alpha + l2))
            if len(used):
                gv = g * share * (s - va) + factor_l2 * va
                nv[used] += gv * gv
                v[used] = va - factor_rate * gv / np.sqrt(nv[used])
    return Machine(bias, w, v)


def calibration(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """The slope (at least 1) and offset of least log loss for margins of rows that the machine has not seen, by damped Newton steps.

    One label each way is added in fractions to both classes, so that separable rows give a finite slope.
    """
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((np.logaddexp(0, z) - target * z).sum())

    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        gradient = x.T @ (p - target)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 1e-3 else (1.0, 0.0)


def fitted(rows: list[np.ndarray], labels: list[int], **options) -> Machine:
    """``learn`` on all rows, calibrated by the margins of every row under a machine that was learned without its fold."""
    y = np.array(labels, np.int64)
    margins = np.zeros(len(rows))
    # folds hold equal shares of each label
    place = np.empty(len(rows), np.int64)
    for k in (0, 1):
        at = np.flatnonzero(y == k)
        place[at] = np.arange(len(at)) % FOLDS
    for fold in range(FOLDS):
        seen, unseen = np.flatnonzero(place != fold), np.flatnonzero(place == fold)
        machine = learn([rows[i] for i in seen], [labels[i] for i in seen], **options)
        margins[unseen] = [machine.margin(rows[i]) for i in unseen]
    machine = learn(rows, labels, **options)
    machine.slope, machine.offset = calibration(margins, y)
    return machine


def hashed(text: Column) -> Column:
    """The buckets of a text's terms, so that no text goes to the driver."""

    @F.arrow_udf("array<int>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with tables("toxicity"):
            for batch in batches:
                got = [terms(t) for _, texts in pieces(batch) for t in texts]
                ends = pa.array(np.cumsum([0, *map(len, got)]), pa.int32())
                yield pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*got, np.empty(0, np.int64)]).astype(np.int32)))

    return found(text)


def fit(labelled: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_of_label: tuple[int, int] = ROWS_OF_LABEL) -> Machine | None:
    """Learn from ``labelled`` (ids and 0/1 labels) on at most ``rows_of_label`` rows of each label, drawn by a hash of the id.

    The driver gets the hashed terms of the drawn rows: at most ``BUCKETS`` numbers each, whatever the length of their texts.
    """
    truth = labelled.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in truth.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    span, draw = 1 << 30, F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    bound = lambda y: min(span, int(span * rows_of_label[y] * 1.1 / sizes[y]) + 1) if y in sizes else 0
    drawn = truth.select("id", "y", draw.alias("draw")).filter(F.col("draw") < F.when(F.col("y") == 1, bound(1)).otherwise(bound(0)))
    parts = [drawn.filter(F.col("y") == y).orderBy("draw", "id").limit(rows_of_label[y]) for y in (0, 1)]
    # at most the two bounds of ids, so they may be sent to every executor; of documents that share an id one is taken
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(parts[0].unionByName(parts[1])), "id")
    one = rows.groupBy("id", "y", "draw").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = one.select("y", "draw", "id", hashed(F.col("text")).alias("at")).toArrow().sort_by([("draw", "ascending"), ("id", "ascending")])
    if not got.num_rows:
        return None
    at = got["at"].combine_chunks()
    feats, labels = [at[i].values.to_numpy().astype(np.int64) for i in range(got.num_rows)], got["y"].to_pylist()
    del got, at
    machine = fitted(feats, labels)
    release("toxicity")
    return machine


def score(df: DataFrame, machine: Machine | None, text_col: str = "text") -> Column:
    """The probability of label 1 for ``df[text_col]``."""
    if machine is None:
        return F.lit(0.0)
    at = np.flatnonzero((machine.weights != 0) | machine.factors.any(1))
    held = df.sparkSession.sparkContext.broadcast((machine.bias, machine.slope, machine.offset, at, machine.weights[at], machine.factors[at]))  # at most one entry a bucket

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bias, slope, offset, at, w, v = held.value
        m = Machine(bias, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)), slope, offset)
        m.weights[at], m.factors[at] = w, v
        with tables("toxicity"):
            for batch in batches:
                yield pa.array([m.score(t) for _, texts in pieces(batch) for t in texts], pa.float64())

    return scored(F.col(text_col).cast("string"))
