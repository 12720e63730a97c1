"""Quality by ordinal cumulative-link regression over hashed text.

Grades are ordered: 0 toxic, 1 junk, 2 good. One weight per hashed feature serves all grades and
ordered thresholds part them: P(grade <= k) = sigmoid(threshold_k - weights . x). The scorer gives the
expected grade and the tail probability P(grade >= 2), by which documents are selected.

Features of a text are the distinct words (lower case), their first 3, 4 and 5 bytes, runs of
punctuation at their ends, capitals, and tenths of repetition; all are hashed to ``BUCKETS``. The
model is fitted on at most ``max_rows`` rated documents chosen by a hash of doc_id; every whole text
is scored. Null and empty texts have only their repetition feature and get a score like any other.
Columns of the names that ``score`` adds are replaced, and ``keep_good`` keeps the columns of its input as they are. Very long texts are
one set of features. Rows rated more than once, and rows that share a rated doc_id, count as often; a rating with a null part is left out. Without any rating
every document gets the top grade. Ties and repeated rows need no rule, as each row is scored alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import free_name, relieve_driver
from strandloom.llm.worker import claim

BUCKETS = 1 << 18
GRADES = 3
POWER = 0.4
#: Documents that have the top grade with less probability are rejected.
MIN_P = 0.4
WORDS_KEPT = 600_000
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_words: dict[str, bytes] = {}


def _word_buckets(word: str) -> bytes:
    core = word.strip(_PUNCTUATION)
    low = core.lower().encode("utf-8", "surrogatepass")
    found = [crc32(low, 1), crc32(low[:3], 3), crc32(low[:4], 4), crc32(low[:5], 5)]
    tail = word[len(word.rstrip(_PUNCTUATION)) :]
    if len(tail) > 1 or not core:
        found.append(crc32(tail[:4].encode(), 6))
    if len(core) > 1 and core.isupper():
        found.append(7)
    return array("i", [f & BUCKETS - 1 for f in found]).tobytes()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a whole text."""
    claim("quality", _words.clear)
    words = (text or "").split()
    distinct = set(words)
    new = [w for w in distinct if w not in _words]
    if len(_words) + len(new) > WORDS_KEPT:
        _words.clear()
        new = distinct
    _words.update((w, _word_buckets(w)) for w in new)
    same = sum(map(eq, words, words[1:])) * 10 // max(len(words) - 1, 1)
    extra = [10 + same, 30 + len(distinct) * 10 // max(len(words), 1)]
    return np.unique(np.frombuffer(b"".join([*map(_words.__getitem__, distinct), array("i", extra).tobytes()]), np.int32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) for each text and k."""
        s = np.array([self.weights[f].sum() / scale(len(f)) for f in x])
        return _sigmoid(s[:, None] - self.thresholds[None, :])


def scale(n: int | np.ndarray) -> float | np.ndarray:
    """Between the plain sum, in which long texts drown, and the unit vector, in which a few bad words do."""
    return np.maximum(n, 1) ** POWER


def fit_ordinal(x: list[np.ndarray], grades: np.ndarray, updates: int = 2400, batch: int = 32, rate: float = 0.3, l2: float = 1e-5, seed: int = 7) -> OrdinalModel:
    """Adagrad on the cumulative-link likelihood; thresholds are a first one and gaps, kept positive as exponentials."""
    w, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    part = np.array([np.mean(grades <= k) if len(grades) else 0.5 for k in range(GRADES - 1)]).clip(0.01, 0.99)
    theta = np.maximum.accumulate(np.log(part / (1 - part)) + 0.1 * np.arange(GRADES - 1))
    raw = np.concatenate((theta[:1], np.log(np.diff(theta) + 1e-3)))
    raw_squares = np.full(len(raw), 1e-3)
    order = np.random.default_rng(seed)
    weight_of = len(grades) / (GRADES * np.bincount(grades, minlength=GRADES).clip(1))
    weight_of = np.sqrt(weight_of)
    epochs = max(6, -(-updates * batch // max(len(grades), 1)))  # small samples are seen more often
    for _ in range(epochs if len(grades) else 0):
        shuffled = order.permutation(len(grades))
        for i in range(0, len(grades), batch):
            rows = shuffled[i : i + batch]
            sizes = np.array([len(x[r]) for r in rows])
            flat, at = np.concatenate([x[r] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
            s = np.bincount(at, w[flat], len(rows)) / scale(sizes)
            theta = np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))))
            below = np.concatenate((np.zeros((len(rows), 1)), _sigmoid(theta[None, :] - s[:, None]), np.ones((len(rows), 1))), axis=1)
            y = grades[rows]
            hi, lo = below[np.arange(len(rows)), y + 1], below[np.arange(len(rows)), y]
            p = np.maximum(hi - lo, 1e-9)
            slope_hi, slope_lo = hi * (1 - hi), lo * (1 - lo)
            v = weight_of[y]
            g_s = v * (slope_hi - slope_lo) / p
            touched, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, (g_s / scale(sizes))[at], len(touched)) / len(rows) + l2 * w[touched]
            squares[touched] += g * g
            w[touched] -= rate * g / np.sqrt(squares[touched])
            g_theta = np.array([(-(v * slope_hi / p)[y == k].sum() + (v * slope_lo / p)[y == k + 1].sum()) / len(rows) for k in range(GRADES - 1)])
            g_raw = np.concatenate(([g_theta.sum()], [g_theta[k:].sum() * np.exp(raw[k]) for k in range(1, GRADES - 1)]))
            raw_squares += g_raw * g_raw
            raw -= 0.1 * g_raw / np.sqrt(raw_squares)
    theta = np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))))
    if not len(grades):
        theta = np.full(GRADES - 1, -20.0)
    return OrdinalModel(w, theta)


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [features(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("grade"), pa.array(raw, pa.binary())], ["h", "grade", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> OrdinalModel:
    """Learn from at most ``max_rows`` rated documents, chosen by a hash of doc_id."""
    rated = labels.where("quality is not null and toxic is not null and doc_id is not null").select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"), F.xxhash64("doc_id").alias("h"))
    n, span = rated.count(), 1 << 40
    rated = rated.where(F.pmod("h", F.lit(span)) < min(span, span * max_rows // max(n, 1)))
    found = docs.select("doc_id", "text").join(rated, "doc_id").select("h", "grade", "text").mapInArrow(_with_features, "h long, grade int, x binary")
    # features are made where the texts are; of those, a bounded number goes on
    rows = found.orderBy("h", "grade", "x").limit(max_rows).collect()
    model = fit_ordinal([np.frombuffer(bytes(r["x"]), np.int32) for r in rows], np.array([r["grade"] for r in rows], int))
    del rows
    relieve_driver(docs.sparkSession)
    return model


def score(docs: DataFrame, model: OrdinalModel, expected: str = "expected_grade", p_good: str = "p_good") -> DataFrame:
    """All columns of ``docs`` and the expected grade and the top grade's probability, under the names given; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = shared.value.tails([features(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*b.schema.names, expected, p_good])

    own = docs.drop(expected, p_good)
    return own.mapInArrow(run, T.StructType(list(own.schema.fields)).add(expected, "double").add(p_good, "double"))


def keep_good(docs: DataFrame, labels: DataFrame, min_p: float = MIN_P, max_rows: int = 12_000) -> DataFrame:
    """The documents that have the top grade with probability ``min_p`` or more."""
    grade, p = free_name(docs, "__grade"), free_name(docs, "__p")
    return score(docs, fit(docs, labels, max_rows), grade, p).where(F.col(p) >= min_p).select(*docs.columns)
