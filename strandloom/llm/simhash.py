"""SimHash near-duplicates by pivot distance tables.

``fingerprints`` reads whole texts; ``simhash_classes`` links fingerprints at RADIUS (two) or fewer
differing bits. Every distinct fingerprint keeps its Hamming distances to a table of fixed reference
fingerprints (pivots). Pairs that agree on three of five bit blocks (any pair within two bits does)
meet in a bucket; a pair is discarded if any coordinate of the two pivot rows differs by more than
the radius (two), and the survivors are verified bit by bit. Buckets with more than ``dense`` members
use the members' own one-bit neighbourhoods as local pivots: two members at distance one or less
from the same pivot are within two bits by the triangle inequality, and any two within two bits
share such a pivot, so a star around each pivot has every link without any pair of the bucket. The change
of pivots is there because pairs of a crowded bucket grow with its square; no link differs by it (tests hold three sizes of
``dense`` against all pairs). On 10,000 documents of the driver's 17 pairs met, and the pivots discarded the 12 that were no links.

The pipeline's stage (``similar_dedup``) has another rule: Jaccard similarity 0.8 over sets of five-word
shingles. Fingerprints of such pairs differ in about 20 of their 128 bits, where no block of useful width
is left equal, but the nearest pivots are often the same. So each text keeps its nearest of 256 pivots, by the Hamming distance
that weighs each bit with its votes, in ``NEAR_PARTS`` pivot distance tables; texts with the same nearest pivots in one of
``NEAR_TABLES`` such groups of tables meet, pairs with more than ``NEAR_RADIUS`` differing bits are discarded, and the survivors are verified
exactly. A simulated pair of similarity 0.8 meets so with probability 0.9 (60 to 300 shingles; 0.7 for 6). MinHash bands (``NEAR_BANDS`` of three values; probability
0.999) are there as well, so none is lost that meets in either; they are linked first, and the pivots compare what is in different components then.

Cases: null and wordless texts have fingerprint zero and are linked like any other; repeated rows and
equal texts collapse to one fingerprint before any join; an empty table gives an empty result; other
columns of the input are not looked at. ``near_dedup`` and ``similar_dedup`` keep rows without a doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import connected_components, write_table
from strandloom.llm.similar import links_between, similar_links
from strandloom.llm.substrings import SHINGLE as NEAR_SHINGLE
from strandloom.llm.substrings import SIMILARITY, band_keys, line_ids, mix, shingles_of, words_of
from strandloom.llm.worker import claim

SEED = 42
SHINGLE = 3
RADIUS = 2
PIVOTS = 16
DENSE = 48
_BLOCKS = (13, 13, 13, 13, 12)
NEAR_BANDS = 10
#: Bits of the fingerprints of ``near_classes``, and pivots of a table, half of which are the others' complements.
NEAR_BITS = 128
NEAR_TABLES, NEAR_PARTS = 40, 3
#: A pair of similarity 0.8 differs in 19 bits, with a standard deviation of 4.
NEAR_RADIUS = 48


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one whole text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    n = max(len(words) - shingle + 1, 1)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[min(shingle, len(words)) - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_values(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints from a fixed generator, as signed longs."""
    return [_signed(xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED)) for i in range(n)]


def _block_masks() -> list[int]:
    masks, low = [], 0
    for width in _BLOCKS:
        masks.append(((1 << width) - 1) << low)
        low += width
    return masks


def _kept_masks() -> list[int]:
    blocks = _block_masks()
    return [sum(c) for c in combinations(blocks, len(blocks) - RADIUS)]


def fingerprint_links(fps: DataFrame, n_pivots: int = PIVOTS, dense: int = DENSE) -> DataFrame:
    """Distinct ``fp`` -> (src, dst) links whose components are those of all pairs within RADIUS bits."""
    pivots = pivot_values(n_pivots)
    kept = _kept_masks()
    table = fps.select("fp", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots]).alias("pd"))
    keyed = table.select("fp", "pd", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(kept)])).alias("key")).select("fp", "pd", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met, _ = write_table(keyed.join(sizes, ["k", "v"]), "buckets")
    a, b = met.where(F.col("n") <= dense).alias("a"), met.where(F.col("n") <= dense).alias("b")
    near = F.lit(True)
    for i in range(n_pivots):
        near = near & (F.abs(F.col("a.pd")[i] - F.col("b.pd")[i]) <= RADIUS)
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = pairs.where(near).where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    free = F.create_map(*[x for i, m in enumerate(kept) for x in (F.lit(i), F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << j)) for j in range(64) if not m >> j & 1]))])
    local = met.where(F.col("n") > dense).select("k", "v", "fp", F.explode(free[F.col("k")]).alias("flip"))
    # a pivot has one bit flipped or none, so at most 65 fingerprints meet at it
    stars = local.groupBy("k", "v", F.col("fp").bitwiseXOR(F.col("flip")).alias("ref")).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst")
    return pairs.union(stars)


def simhash_classes(docs: DataFrame, n_pivots: int = PIVOTS, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    fps, _ = write_table(fingerprints(docs), "fingerprints")
    classes, _ = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    comps = connected_components(fingerprint_links(classes, n_pivots, dense))
    named = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = named.join(lows, "component").select("fp", "component_id")
    return fps.join(ids, "fp", "left").select("doc_id", "fp", "component_id")


def _near_shingles(text: str | None) -> np.ndarray:
    """Sorted distinct five-word shingles; a text of fewer words is one shingle, one without words none."""
    hashes, _, _ = words_of((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(shingles_of(hashes) if len(hashes) >= NEAR_SHINGLE else shingles_of(np.resize(hashes, NEAR_SHINGLE)))


def _near_id(found: np.ndarray) -> int:
    return int(line_ids(found, np.array([[0, len(found)]])).view(np.int64)[0]) if len(found) else 0


@lru_cache(maxsize=1)
def _near_pivots() -> np.ndarray:
    """Bits x pivots of all tables, as 1 and -1; their complements are not listed."""
    n = NEAR_TABLES * NEAR_PARTS * NEAR_BITS
    bits = np.unpackbits(mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(SEED << 32)).view(np.uint8).reshape(n, NEAR_BITS // 8), axis=1)
    return np.ascontiguousarray(bits.T.astype(np.float32) * 2 - 1)


def _votes(found: np.ndarray) -> np.ndarray:
    """For each bit of a fingerprint, how many more of the shingles have it set than not."""
    ones = np.zeros(NEAR_BITS, np.int64)
    for i in range(0, len(found), 1 << 14):
        h = found[i : i + (1 << 14)]
        ones += np.unpackbits(np.column_stack((h, mix(h + np.uint64(SEED)))).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * ones - len(found)


def pivot_keys(votes: np.ndarray) -> np.ndarray:
    """Texts x NEAR_TABLES: the nearest pivots in NEAR_PARTS tables, as one number.

    The distance of a text to a pivot is the sum of votes of the bits that differ, which is the least for the greatest product.
    """
    near = (votes.astype(np.float32) @ _near_pivots()).reshape(len(votes), -1, NEAR_BITS)
    at = np.abs(near).argmax(axis=2)
    of = (2 * at + (np.take_along_axis(near, at[:, :, None], axis=2)[:, :, 0] > 0)).reshape(len(votes), NEAR_TABLES, NEAR_PARTS)
    cells = np.broadcast_to(np.arange(NEAR_TABLES), of.shape[:2])
    for part in range(NEAR_PARTS):
        cells = cells * (2 * NEAR_BITS) + of[:, :, part]
    return cells.astype(np.int32)


_NEAR_SCHEMA = "doc_id long, id long, n int, fp array<long>, keys array<long>, pivots array<int>"


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("near", _near_pivots.cache_clear)
    for b in (part for whole in batches for part in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256))):
        sets = [_near_shingles(text) for text in b.column("text").to_pylist()]
        votes = np.array([_votes(found) for found in sets])
        fps = np.packbits(votes > 0, axis=1).view(np.int64)
        pivots = pivot_keys(votes)
        keys = [band_keys(found, np.array([[0, len(found)]]), NEAR_BANDS)[0].view(np.int64) if len(found) else [] for found in sets]
        arrays = [pa.array([_near_id(found) for found in sets], pa.int64()), pa.array([len(found) for found in sets], pa.int32())]
        arrays += [pa.array(list(fps), pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array([p if len(found) else [] for p, found in zip(pivots, sets)], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", "id", "n", "fp", "keys", "pivots"])


def _near_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("near", _near_pivots.cache_clear)
    for b in (part for whole in batches for part in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256))):
        sets = [_near_shingles(t) for t in b.column("text").to_pylist()]
        same = [_near_id(s) == own for s, own in zip(sets, b.column("id").to_pylist())]  # another row may share the doc_id
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "shingles"]).filter(pa.array(same, pa.bool_()))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, id, component_id): documents whose sets of five-word shingles have Jaccard similarity 0.8 or more, and those linked through others, share a component.

    Texts with equal sets are one for all comparisons; the sets of those that share a key with others are read from the
    texts again. Rows without doc_id are linked to nothing.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text")
    table, _ = write_table(own.mapInArrow(_near_batches, _NEAR_SCHEMA), "near")
    firsts = table.where("doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("low"), *[F.any_value(c).alias(c) for c in ("n", "fp", "keys", "pivots")])
    texts, _ = write_table(firsts, "texts")

    def sets_of(wanted: DataFrame) -> DataFrame:
        places = texts.join(wanted, "id", "left_semi").select("id", F.col("low").alias("doc_id"))
        return own.join(places, "doc_id").select("id", "text").mapInArrow(_near_sets, "id long, shingles array<long>")

    links, _ = write_table(similar_links(texts.select("id", "keys"), similarity, sets_of=sets_of), "links")
    further = links_between(texts.select("id", "n", "fp", F.col("pivots").alias("keys")), connected_components(links), similarity, NEAR_RADIUS, sets_of)
    comps = connected_components(links.union(further))
    named = texts.select("id", "low").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = named.join(lows, "component").select("id", "component_id")
    return table.select("doc_id", "id").join(ids, "id", "left").select("doc_id", "id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _keep_first(docs: DataFrame, classed: DataFrame) -> DataFrame:
    gone = classed.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id. All columns are kept.

    Rows that repeat the kept doc_id stay as they are, and so do rows without a doc_id, as nothing
    tells them apart.
    """
    return _keep_first(docs, simhash_classes(docs))


def similar_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``near_dedup`` by the classes of ``near_classes``."""
    return _keep_first(docs, near_classes(docs, similarity))
