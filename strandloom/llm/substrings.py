"""Substring dedup: paragraphs that repeat across documents, by MinHash banding.

Paragraphs are of two kinds. Lines, and blocks of lines between blank ones, of ``MIN_LINE`` words or
more (those with a shingle) are natural ones. As passages also
stand inside lines, content-defined paragraphs of ``WORDS`` words begin wherever a five-word shingle has
the smallest hash of ``WINNOW`` shingles in a row: a passage of 50 words or more, wherever it stands,
has one of them whole. The first kind is banded (``BANDS`` bands of ``ROWS`` MinHash values: a pair of
similarity 0.8 collides with probability 0.97, one of 0.9 with 0.999); all lines that collide are
linked by exact Jaccard similarity over five-word shingles, 0.8 or more (``similar_links``). Only lines that collide
with another are looked up in their texts again, for their shingles (``line_sets``). The second kind has one band of
all its shingles: equal paragraphs only, however many, which are compared word by word with the kept one before they go.

The classes of verified links are components; in each the occurrence in the smallest doc_id stays and
those in other documents go. What is removed is whole words: a line, or a content-defined paragraph and
the words around it as far as they agree with those around the kept occurrence. ``REACH`` words are
compared at either end, as a longer agreement has another paragraph there. Words between two paragraphs
go only where they agree. Repeats inside the keeping document stay.

Cases: null and short texts have no paragraphs and stay; rows without doc_id neither keep nor lose
anything; rows that share a doc_id count as one document, and a span is only cut where the text's words
have the paragraph's hash; of equal paragraphs the first of the smallest doc_id is kept; very long texts are
hashed in parts; further columns of any name are kept; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import connected_components, free_name, remove_path, scratch_of_thread, write_table
from strandloom.llm.similar import similar_links
from strandloom.llm.worker import claim

SHINGLE = 5
WORDS = 24
WINNOW = 24
MIN_LINE = SHINGLE
BANDS, ROWS = 5, 3
REACH = WINNOW + SHINGLE
SIMILARITY = 0.8
#: Words of a kept document whose paragraphs are looked up together.
CHUNK = 128
#: Runs of one chunk that are joined to its words by a shuffle; those of more common ones get them broadcast.
CROWD = 512
_PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=16)
def _numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed * 2 + 1) + np.uint64(seed)) | np.uint64(1)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of UTF-8 text, parted by ASCII white space."""
    data = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], (data == 32) | ((data >= 9) & (data <= 13)), [True]))
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    hashes, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):  # powers are needed for a part only, so a very long text costs no more
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + _PART, side="right")))
        a, b = starts[k:last] - starts[k], ends[k:last] - starts[k]
        up, down = _power_tables(int(b[-1]) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data[starts[k] : ends[last - 1]].astype(np.uint64) + np.uint64(1)) * up[: b[-1]], dtype=np.uint64)))
        hashes[k:last] = (sums[b] - sums[a]) * down[a]
        k = last
    return mix(hashes), starts, ends


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_numbers(SHINGLE, 1)):
        out += hashes[j : j + n] * c
    return mix(out)


def paragraph_ids(shingles: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit id of the WORDS words at each place."""
    m = WORDS - SHINGLE + 1
    rows = shingles[places[:, None] + np.arange(m)]
    return mix((rows * _numbers(m, 2)).sum(axis=1, dtype=np.uint64))


def _segments(values: np.ufunc, of: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A reduction over of[a:b] for each (a, b), which are not empty and in order."""
    return values.reduceat(np.append(of, of[-1:]), bounds.ravel())[::2]


def line_ids(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each line, given the bounds of its shingles."""
    return mix(_segments(np.add, mix(shingles + np.uint64(9)), bounds) + (bounds[:, 1] - bounds[:, 0]).astype(np.uint64))


def band_keys(shingles: np.ndarray, bounds: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Lines x bands: a hash of each band's smallest values under ROWS orders."""
    lows = np.array([_segments(np.minimum, (shingles ^ m) * m, bounds) for m in _numbers(bands * ROWS, 3)], np.uint64)
    rows = lows.T.reshape(len(bounds), bands, ROWS)
    return mix((rows * _numbers(ROWS, 4)).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


_SCHEMA = "kind tinyint, id long, doc_id long, first int, size int, keys array<long>"
#: Bytes of texts that are looked at together.
TOGETHER = 1 << 20


@dataclass
class Texts:
    """The words of several texts in a row: their hashes, and shingles, of which those over two texts are never used."""

    hashes: np.ndarray
    shingles: np.ndarray
    begins: np.ndarray  # the first word of each text, and the number of words
    breaks: np.ndarray  # the word after each line end

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw)
        hashes, starts, _ = words_of(joined)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        begins = np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(hashes))
        breaks = np.searchsorted(starts, np.flatnonzero(np.frombuffer(joined, np.uint8) == 10))
        return cls(hashes, shingles_of(hashes), begins, breaks)

    def lines(self) -> np.ndarray:
        """(first word, end) of lines, and of blocks of several lines between blank ones, of at least MIN_LINE words; in order."""
        ends, times = np.unique(self.breaks, return_counts=True)
        cuts = [np.unique(np.concatenate((inner, self.begins))) for inner in (ends, ends[times > 1])]
        found = np.unique(np.concatenate([np.column_stack((c[:-1], c[1:])) for c in cuts]), axis=0)
        return found[found[:, 1] - found[:, 0] >= MIN_LINE]

    def anchors(self) -> np.ndarray:
        """Where content-defined paragraphs begin."""
        bounds = np.column_stack((self.begins[:-1], self.begins[1:] - SHINGLE + 1))  # of each text's shingles
        least, n = WORDS - SHINGLE + 1, len(self.shingles)
        found = [np.empty(0, np.int64)]
        for a, b in bounds[(bounds[:, 1] - bounds[:, 0] >= least) & (bounds[:, 1] - bounds[:, 0] < WINNOW)].tolist():
            found.append(np.array([a + int(self.shingles[a:b].argmin())]))
        inside = np.zeros(max(n - WINNOW + 1, 0) + 1, np.int8)  # windows that lie in one text
        long = bounds[bounds[:, 1] - bounds[:, 0] >= WINNOW]
        np.add.at(inside, long[:, 0], 1)
        np.add.at(inside, long[:, 1] - WINNOW + 1, -1)
        windows = np.flatnonzero(np.cumsum(inside[:-1]))
        for i in range(0, n - WINNOW + 1, _PART):
            part = self.shingles[i : i + _PART + WINNOW - 1]
            lows = np.lib.stride_tricks.sliding_window_view(part, WINNOW).argmin(axis=1)
            own = windows[np.searchsorted(windows, i) : np.searchsorted(windows, i + len(lows))]
            found.append(np.unique(lows[own - i] + own))
        places = np.unique(np.concatenate(found))
        return places[places + least <= self.begins[self.text_of(places) + 1] - SHINGLE + 1]

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins[:-1], words, side="right") - 1


def together(b: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about TOGETHER bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, side="right")))
        yield b.slice(at, end - at)
        at = end


def paragraphs(docs: DataFrame) -> DataFrame:
    """One row per paragraph: kind 0, content-defined, or 1, a line or block, with its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings", lambda: None)
        for b in (part for whole in batches for part in together(whole)):
            texts = Texts.of(b.column("text").to_pylist())
            places, lines = texts.anchors(), texts.lines()
            bounds = lines - [0, SHINGLE - 1]
            ids = [np.empty(0, np.uint64)]
            keys = np.empty(0, np.uint64)
            if len(places):
                ids.append(paragraph_ids(texts.shingles, places))
            if len(lines):
                ids.append(line_ids(texts.shingles, bounds))
                keys = band_keys(texts.shingles, bounds).ravel()
            first = np.concatenate((places, lines[:, 0]))
            of = texts.text_of(first)
            size = np.concatenate((np.full(len(places), WORDS), lines[:, 1] - lines[:, 0]))
            kind = np.repeat(np.array([0, 1], np.int8), [len(places), len(lines)])
            offsets = np.concatenate(([0], np.cumsum(kind.astype(np.int32) * BANDS)))
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64)), mask=pa.array(kind == 0))
            arrays = [pa.array(kind), pa.array(np.concatenate(ids).view(np.int64)), b.column("doc_id").take(pa.array(of)), pa.array((first - texts.begins[of]).astype(np.int32)), pa.array(size.astype(np.int32)), keys]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "id", "doc_id", "first", "size", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, _SCHEMA)


def line_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, shingles) of the lines (doc_id, first, size, id) in ``places``: the distinct five-word shingles, 64 bits of each. A row for each of ``docs`` that has the line there."""
    own = places.groupBy("doc_id").agg(F.collect_list(F.struct("first", "size", "id")).alias("places"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(own, "doc_id").select("text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128))):
            ids, sets = [], []
            for text, lines in zip(b.column("text").to_pylist(), b.column("places").to_pylist()):
                hashes, _, _ = words_of((text or "").encode("utf-8", "surrogatepass"))
                sh = shingles_of(hashes)
                for first, size, own_id in (tuple(x.values()) for x in lines):
                    if _has(hashes, sh, 1, own_id, first, size):
                        ids.append(own_id)
                        sets.append(np.unique(sh[first : first + size - SHINGLE + 1]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles array<long>")


def line_links(lines: DataFrame, similarity: float = SIMILARITY, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(src, dst) of line ids: links whose components are those of all pairs that share a band and whose exact similarity suffices."""
    return similar_links(lines, similarity, sets_of=sets_of)


def repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every occurrence of a paragraph that stands in more than one document.

    (doc_id, kind, first, size, id, component_id, kept_doc_id, kept_first, removed): words first to
    first + size of doc_id; removed is False in the keeping document.
    """
    table, _ = write_table(paragraphs(docs), "paragraphs")
    occurrences = table.where("kind = 1").select("id", "doc_id", "first", "size", "keys")
    lines, _ = write_table(occurrences.groupBy("id").agg(F.min(F.struct("doc_id", "first", "size")).alias("at"), F.any_value("keys").alias("keys")), "lines")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return line_sets(docs, lines.join(wanted, "id", "left_semi").select("id", "at.*"))

    components = connected_components(line_links(lines.select("id", "keys"), similarity, sets_of))
    near = occurrences.drop("keys").join(components.withColumnRenamed("node", "id"), "id", "left")
    near = near.select(F.lit(1).cast("tinyint").alias("kind"), "id", F.coalesce("component", "id").alias("component_id"), "doc_id", "first", "size")
    every = table.where("kind = 0").select("kind", "id", F.col("id").alias("component_id"), "doc_id", "first", "size").union(near)
    classes = every.groupBy("kind", "component_id").agg(F.min(F.struct("doc_id", "first")).alias("kept"), F.max("doc_id").alias("last")).where("kept.doc_id <> last")
    # as a table, so that both sides of the join are shuffled for it alone and occurrences of one common class may be split
    classes, _ = write_table(classes.select("kind", "component_id", "kept"), "classes")
    found = every.join(classes, ["kind", "component_id"])
    return found.select("doc_id", "kind", "first", "size", "id", "component_id", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.first").alias("kept_first"), (F.col("doc_id") != F.col("kept.doc_id")).alias("removed"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, end), parted."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            first, last = out.pop()
            end = max(end, last)
        out.append((first, end))
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many words agree from the start."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def _words32(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype(np.uint32).view(np.int32)


def _has(hashes: np.ndarray, shingles: np.ndarray, kind: int, own: int, first: int, size: int) -> bool:
    """Whether the words from first on have a paragraph's hash."""
    if first + size > len(hashes):
        return False
    found = line_ids(shingles, np.array([[first, first + size - SHINGLE + 1]])) if kind else paragraph_ids(shingles, np.array([first]))
    return int(found.view(np.int64)[0]) == own


def cut_text(text: str, spans: list[tuple[int, int, int, int, list[int] | None, list[int] | None]]) -> str:
    """The text without the spans (kind, id, first, size, kept words before, kept words from there on) whose words still have their hash and, of kind 0, are the kept words; each as far as the words around agree with the kept ones."""
    raw = text.encode("utf-8", "surrogatepass")
    hashes, starts, ends = words_of(raw)
    sh, low = shingles_of(hashes), _words32(hashes)
    good = []
    for kind, own, first, size, before, after in spans:
        if not _has(hashes, sh, kind, own, first, size):
            continue
        if kind:
            good.append((first, first + size))
            continue
        right = _agree(low[first : first + size + REACH], np.array(after or [], np.int32))
        if right >= size:
            left = _agree(low[max(first - REACH, 0) : first][::-1], np.array(before or [], np.int32)[::-1])
            good.append((first - left, first + right))
    parts, at = [], 0
    for a, b in merge_spans(good):
        parts.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    parts.append(raw[at:])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def runs_of(spans: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id, chunk, places): content-defined paragraphs that a document lost, those that begin in the same ``CHUNK`` words of a kept document in one row.

    However often a passage is copied in a document, its words are joined once; ``places`` has their (first, kept_first, id).
    """
    of = F.floor(F.col("kept_first") / CHUNK).cast("int")
    own = spans.where("kind = 0").select("doc_id", "kept_doc_id", of.alias("chunk"), "first", "kept_first", "id")
    return own.groupBy("doc_id", "kept_doc_id", "chunk").agg(F.collect_list(F.struct("first", "kept_first", "id")).alias("places"))


def kept_words(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(kept_doc_id, chunk, begin, words): the words (32 bits of their hashes) of kept documents from ``begin`` on that lie within REACH of the content-defined paragraphs beginning in a chunk.

    Rows that share a doc_id give a row each where they have a paragraph that no smaller one of them has.
    """
    places = spans.where("kind = 0").select("kept_doc_id", "kept_first", "id").distinct()
    places = places.groupBy("kept_doc_id").agg(F.collect_list(F.struct("kept_first", "id")).alias("places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("kept_doc_id"), "text").join(places, "kept_doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256))):
            of, chunks, begins, words, ids = [], [], [], [], []
            for doc, text, own in zip(b.column("kept_doc_id").to_pylist(), b.column("text").to_pylist(), b.column("places").to_pylist()):
                hashes, _, _ = words_of((text or "").encode("utf-8", "surrogatepass"))
                sh, low = shingles_of(hashes), _words32(hashes)
                found: dict[int, list[tuple[int, int]]] = {}
                for first, ident in sorted(tuple(x.values()) for x in own):
                    if _has(hashes, sh, 0, ident, first, WORDS):
                        found.setdefault(first // CHUNK, []).append((first, ident))
                for chunk, there in found.items():
                    begin = max(there[0][0] - REACH, 0)
                    of.append(doc)
                    chunks.append(chunk)
                    begins.append(begin)
                    words.append(low[begin : there[-1][0] + WORDS + REACH])
                    ids.append([i for _, i in there])
            arrays = [pa.array(of, pa.int64()), pa.array(chunks, pa.int32()), pa.array(begins, pa.int32()), pa.array(words, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["kept_doc_id", "chunk", "begin", "words", "ids"])

    table = texts.select("kept_doc_id", "text", "places").mapInArrow(run, "kept_doc_id long, chunk int, begin int, words array<int>, ids array<long>")
    # rows that share a doc_id may hold the same places, and many of them nearly the same: no more are kept than there are paragraphs
    table, _ = write_table(table.withColumn("w", F.xxhash64("begin", "words")), "words")
    least = table.select("kept_doc_id", "chunk", "w", F.explode("ids").alias("id")).groupBy("kept_doc_id", "chunk", "id").agg(F.min("w").alias("w"))
    least = least.select("kept_doc_id", "chunk", "w").distinct()
    return table.join(least, ["kept_doc_id", "chunk", "w"], "left_semi").groupBy("kept_doc_id", "chunk", "w").agg(F.min(F.struct("begin", "words")).alias("x")).select("kept_doc_id", "chunk", "x.begin", "x.words")


def _spans_of(lines: list[dict] | None, runs: list[dict] | None) -> list[tuple]:
    """What ``cut_text`` takes, of the lines and runs of one document."""
    spans: list[tuple] = [(1, x["id"], x["first"], x["size"], None, None) for x in lines or []]
    for run in runs or []:
        for place in run["places"]:
            at = place["kept_first"] - run["begin"]
            if at >= 0:
                spans.append((0, place["id"], place["first"], WORDS, run["words"][max(at - REACH, 0) : at], run["words"][at : at + WORDS + REACH]))
    return spans


def remove_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with repeated paragraphs cut from ``text`` (and ``n_chars``, if there is one, counted anew). Every row stays unless nothing but white space is left of it."""
    own = free_name(docs, "__spans")
    with scratch_of_thread() as made:
        lost, path = write_table(repeats(docs, similarity).where("removed").select("doc_id", "kind", "id", "first", "size", "kept_doc_id", "kept_first"), "lost")
    for old in made - {path}:  # nothing reads the tables of the search again
        remove_path(docs.sparkSession, old)
    kept, _ = write_table(kept_words(docs, lost), "kept")
    runs, _ = write_table(runs_of(lost), "runs")
    place = ["kept_doc_id", "chunk"]
    # one in CROWD runs at most is a row of this, so its words can go to all tasks and no task gets all runs of a common passage
    crowds = F.broadcast(runs.groupBy(*place).count().where(F.col("count") > CROWD).select(*place))
    met = runs.join(crowds, place, "left_anti").join(kept, place).union(runs.join(F.broadcast(kept.join(crowds, place, "left_semi")), place))
    # the words that a run needs are cut out of its chunk's before they are shuffled
    ends = F.transform("places", lambda p: p["kept_first"])
    start = F.greatest(F.array_min(ends) - REACH, F.col("begin"))
    around = met.withColumn("start", start).withColumn("n", F.array_max(ends) + WORDS + REACH - F.col("start"))
    run_of = F.struct("places", F.col("start").alias("begin"), F.expr("slice(words, start - begin + 1, greatest(n, 0))").alias("words"))
    lines = lost.where("kind = 1").select("doc_id", F.struct("id", "first", "size").alias("line"), F.lit(None).alias("run"))
    spans = lines.union(around.select("doc_id", F.lit(None).alias("line"), run_of.alias("run")))
    # collect_list leaves nulls out
    spans, _ = write_table(spans.groupBy("doc_id").agg(F.struct(F.collect_list("line").alias("lines"), F.collect_list("run").alias("runs")).alias(own)), "spans")
    joined = docs.join(spans, "doc_id", "left").select(*docs.columns, own)
    text_at, schema = docs.columns.index("text"), T.StructType(list(docs.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_at).to_pylist()
            cut, gone = [], []
            for text, found in zip(texts, b.column(b.num_columns - 1).to_pylist()):
                new = cut_text(text, _spans_of(found["lines"], found["runs"])) if found and text else text
                cut.append(new)
                gone.append(bool(found) and new is not None and not new.strip())
            columns = list(b.columns[:-1])
            columns[text_at] = pa.array(cut, columns[text_at].type)
            kept = pa.array([not g for g in gone])
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(kept)

    out = joined.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
