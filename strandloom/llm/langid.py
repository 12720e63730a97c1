"""Language identification with a blended-spectrum string kernel.

A text is the set of the 1-, 2- and 3-grams of its letters (lower case, every run of other characters
as one space). The kernel of two texts is the number of grams in both over the geometric mean of their
numbers of grams. Landmark texts give Nyström features; one ridge regression per language against the
rest works on those. Both linear maps fold into one matrix, so scoring a batch is a presence matrix
times the landmarks' presence matrix times that matrix.

The model is fitted on a bounded sample: ``per_class`` documents of each language by a hash of doc_id,
of which ``landmarks`` are landmarks; scoring covers every whole text. A null text, or one without a
letter, is ``und`` with score 0. Rows without a language teach nothing, rows that
share a doc_id and a language teach once, by one of their texts. Very long texts are read in windows of ``WINDOW`` characters. With no row to learn from, every
text is ``und``. Ties go to the first language by name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import free_name
from strandloom.llm.worker import claim

UNKNOWN = "und"
WINDOW = 1 << 20
BATCH = 128

_letters: dict[int, np.ndarray] = {}


def _is_letter(last: int) -> np.ndarray:
    """For code points up to ``last``; those beyond the first plane are looked up only where they occur."""
    end = 0x10000 if last < 0x10000 else 0x110000
    if end not in _letters:
        _letters[end] = np.fromiter((chr(i).isalpha() for i in range(end)), bool, end)
    return _letters[end]


def gram_codes(text: str | None) -> np.ndarray:
    """Sorted distinct grams of a whole text, 21 bits a character; empty if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(int(points.max(initial=0)))[points]
    if not letter.any():
        return np.empty(0, np.int64)
    after = np.concatenate(([True], letter[:-1]))  # one space stands for a run of others
    line = np.where(letter, points, 32)[letter | after].astype(np.int64)
    line = np.concatenate(([32], line, [32]))
    found = []
    for i in range(0, len(line), WINDOW):
        one = line[i : i + WINDOW + 2]
        two = one[:-1] << 21 | one[1:]
        three = two[:-1] << 21 | one[2:]
        found.append(np.unique(np.concatenate((one, two, three))))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class KernelModel:
    classes: list[str]
    vocabulary: np.ndarray  # sorted grams of all landmarks
    presence: np.ndarray  # grams x landmarks, over the root of each landmark's number of grams
    weights: np.ndarray  # landmarks x classes
    bias: np.ndarray

    def kernel(self, codes: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(codes), len(self.vocabulary)), np.float32)
        for row, c in enumerate(codes):
            at = np.minimum(np.searchsorted(self.vocabulary, c), len(self.vocabulary) - 1)
            x[row, at[self.vocabulary[at] == c]] = 1 / np.sqrt(max(len(c), 1))
        return x @ self.presence

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for i in range(0, len(texts), BATCH):
            codes = [gram_codes(t) for t in texts[i : i + BATCH]]
            told = [k for k, c in enumerate(codes) if len(c)]
            if not told or not self.classes:
                continue
            f = self.kernel([codes[k] for k in told]).astype(np.float64) @ self.weights + self.bias
            best = f.argmax(axis=1)
            for k, b, s in zip(told, best, np.clip(f.max(axis=1), 0, 1)):
                names[i + k], scores[i + k] = self.classes[b], s
        return names, scores


def fit_kernel(codes: list[np.ndarray], langs: list[str], landmarks: int, ridge: float = 1e-3) -> KernelModel:
    """``codes`` in the order in which landmarks are taken, ``landmarks`` for each language at most."""
    classes = sorted(set(langs))
    if not classes:
        return KernelModel([], np.zeros(1, np.int64), np.zeros((1, 1), np.float32), np.zeros((1, 0)), np.zeros(0))
    taken: dict[str, int] = {}
    marks = []
    for c, lang in zip(codes, langs):
        if taken.get(lang, 0) < landmarks:
            taken[lang] = taken.get(lang, 0) + 1
            marks.append(c)
    vocabulary = np.unique(np.concatenate(marks))
    presence = np.zeros((len(vocabulary), len(marks)), np.float32)
    for k, c in enumerate(marks):
        presence[np.searchsorted(vocabulary, c), k] = 1 / np.sqrt(len(c))
    model = KernelModel(classes, vocabulary, presence, np.zeros((len(marks), len(classes))), np.zeros(len(classes)))
    values, vectors = np.linalg.eigh(presence.T.astype(np.float64) @ presence)
    good = values > 1e-6 * values.max()
    to_features = vectors[:, good] / np.sqrt(values[good])
    phi = model.kernel(codes).astype(np.float64) @ to_features
    y = (np.array(langs)[:, None] == np.array(classes)[None, :]).astype(np.float64)
    share = np.bincount(np.searchsorted(classes, langs), minlength=len(classes))[np.searchsorted(classes, langs)]
    w = (1 / share)[:, None]  # every language counts alike
    mean, middle = (w * phi).sum(0) / w.sum(), (w * y).sum(0) / w.sum()
    z = phi - mean
    solved = np.linalg.solve(z.T @ (w * z) + ridge * w.sum() / len(phi) * np.eye(z.shape[1]), z.T @ (w * (y - middle)))
    model.weights, model.bias = to_features @ solved, middle - mean @ solved
    return model


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that never teaches."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [gram_codes(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(raw, pa.binary())], ["lang", "h", "codes"])


def fit(docs: DataFrame, per_class: int = 300, landmarks: int = 32) -> KernelModel:
    """Learn from at most ``per_class`` documents of each language that are not held out."""
    teach = docs.select("lang", "text", F.xxhash64("doc_id").alias("h"), held_out(F.col("doc_id")).alias("out"), "doc_id")
    teach = teach.where("not out and doc_id is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in teach.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return fit_kernel([], [], landmarks)
    span = 1 << 40
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(span, span * 3 * per_class // (2 * n)))])
    # rows that share a doc_id teach once, so what is collected is bounded for a hot one too
    taken = teach.where(F.pmod("h", F.lit(span)) < limits[F.col("lang")]).groupBy("lang", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = taken.select("lang", "text", "h").mapInArrow(_codes, "lang string, h long, codes binary").collect()
    kept: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["h"] % span, r["codes"])):
        if len(r["codes"]) and len(kept.setdefault(r["lang"], [])) < per_class:
            kept[r["lang"]].append(np.frombuffer(r["codes"], np.int64))
    return fit_kernel([c for lang in kept for c in kept[lang]], [lang for lang in kept for _ in kept[lang]], landmarks)


def predict(docs: DataFrame, model: KernelModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the language and its score, under the names given; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks' grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid", lambda: None)
        for b in batches:
            names, scores = shared.value.predict(b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang, score])

    own = docs.drop(lang, score)
    return own.mapInArrow(run, T.StructType(list(own.schema.fields)).add(lang, "string").add(score, "double"))


def keep_identified(docs: DataFrame, min_score: float = 0.3, **fit_args: int) -> DataFrame:
    """The documents whose language is told with ``min_score`` or more; text without letters, or like no learned language, goes."""
    lang, score = free_name(docs, "__lang"), free_name(docs, "__score")
    told = predict(docs, fit(docs, **fit_args), lang, score)
    return told.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
