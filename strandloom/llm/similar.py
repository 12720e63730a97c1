"""Links of all similar pairs that share a bucket.

Items have an id, bucket keys and a set of shingles, kept apart; a pair is linked if its exact Jaccard similarity
suffices. Small buckets are compared in full. In larger ones all members are compared with one of
them, the star, and those that are not linked with another one, ``ROUNDS`` times. What these links make one component needs no
further link. Members of a bucket that are in different components even then are compared in tiles of bounded size, whose
links alone leave them. So the components are those of all pairs. What collides without being similar is still compared
with all of its bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import connected_components, fewer_files, write_table

#: Members of a bucket that are compared in full.
DENSE = 8
ROUNDS = 3


def shared(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """How many values the sets of each row have in common; no set has a value twice."""
    sizes = [pc.list_value_length(c).to_numpy().astype(np.int64) for c in (x, y)]
    rows = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    values = np.concatenate([c.flatten().to_numpy() for c in (x, y)])
    order = np.argsort(values)
    rows = rows[order].astype(np.uint16 if len(x) < 1 << 16 else np.int64)
    again = np.argsort(rows, kind="stable")  # a radix sort for numbers of 16 bits
    rows, values = rows[again], values[order][again]
    twice = (rows[1:] == rows[:-1]) & (values[1:] == values[:-1])
    return np.bincount(rows[1:][twice], minlength=len(x))


def _measured(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (src, dst) with ``linked`` and their Jaccard distance ``d``."""
    a, b = sets.select(F.col("id").alias("src"), F.col("s").alias("x")), sets.select(F.col("id").alias("dst"), F.col("s").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                part = whole.slice(i, 1024)
                x, y = part.column("x"), part.column("y")
                n = shared(x, y)
                every = pc.list_value_length(x).to_numpy() + pc.list_value_length(y).to_numpy() - n
                yield pa.RecordBatch.from_arrays([part.column("src"), part.column("dst"), pa.array(n >= similarity * every), pa.array(1 - n / np.maximum(every, 1))], ["src", "dst", "linked", "d"])

    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long, linked boolean, d double")


def _crowds(members: DataFrame) -> DataFrame:
    """(key, id, n) of buckets of two or more, with ``m``, how many they are, and ``star``."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("star")).where("m > 1")
    return members.join(sizes, "key")


def _met(items: DataFrame) -> DataFrame:
    """(key, id) of the keys that different ids have. Most keys have one id only, which is told by its minimum and maximum alone."""
    members = items.select("id", F.explode("keys").alias("key"))
    shared, _ = write_table(fewer_files(members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")), "keys")
    return members.join(shared, "key", "left_semi").distinct()


def _pairs(crowds: DataFrame, similarity: float) -> DataFrame:
    """All pairs (src, dst) of each bucket whose sizes allow the similarity; for buckets of few members."""
    a, b = crowds.alias("a"), crowds.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= similarity * F.greatest("a.n", "b.n")))
    return met.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()


#: Members of either side of a tile.
TILE = 4096
_COLUMNS = 2048


def _columns(rows: np.ndarray, values: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``common``) of the values that are there, by place."""
    at = np.minimum(np.searchsorted(common, values), len(common) - 1)
    kept = common[at] == values
    order = np.argsort(at[kept], kind="stable")
    return rows[kept][order], at[kept][order]


def _in_common(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, by products of presence matrices."""
    (rx, vx), (ry, vy) = ((np.repeat(np.arange(len(c)), pc.list_value_length(c).to_numpy()), c.flatten().to_numpy()) for c in (x, y))
    common = np.intersect1d(vx, vy)
    out = np.zeros((len(x), len(y)), np.float32)
    if not len(common):
        return out
    (rx, vx), (ry, vy) = _columns(rx, vx, common), _columns(ry, vy, common)
    for begin in range(0, len(common), _COLUMNS):
        parts = []
        for r, v, n in ((rx, vx, len(x)), (ry, vy, len(y))):
            i, j = np.searchsorted(v, (begin, begin + _COLUMNS))
            part = np.zeros((n, min(_COLUMNS, len(common) - begin)), np.float32)
            part[r[i:j], v[i:j] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _links_in_tile(similarity: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        other = t.column("other").to_numpy().astype(bool)
        a, b = t.filter(pa.array(other)), t.filter(pa.array(~other))
        src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if a.num_rows and b.num_rows:
            x, y = (c.column("s").combine_chunks() for c in (a, b))
            if isinstance(x, pa.ChunkedArray):
                x, y = x.chunk(0), y.chunk(0)
            n, m = (pc.list_value_length(c).to_numpy().astype(np.float64) for c in (x, y))
            ca, cb, ia, ib = a.column("component").to_numpy(), b.column("component").to_numpy(), a.column("id").to_numpy(), b.column("id").to_numpy()
            for i in range(0, len(x), 512):
                both = _in_common(x.slice(i, 512), y).astype(np.float64)  # whole numbers, so exact
                near = (both >= similarity * (n[i : i + 512, None] + m[None, :] - both)) & (ca[i : i + 512, None] != cb[None, :])
                p, q = np.nonzero(near)
                # one link for two components is enough
                _, first = np.unique(np.column_stack((ca[i + p], cb[q])), axis=0, return_index=True)
                src.append(ia[i + p[first]])
                dst.append(ib[q[first]])
        return pa.table({"src": pa.array(np.concatenate(src)), "dst": pa.array(np.concatenate(dst))})

    return run


def _apart(members: DataFrame, components: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) of similar pairs of a bucket in different components, at least one for two components that have any in a tile.

    Most members of a bucket are in one component by now, its home; the others meet all members, in tiles of at most about TILE of either.
    A tile compares by a product of matrices and gives links alone, so no pair is a row.
    """
    own = members.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    homes = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("home"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("m"), F.max("c").alias("at_home")).where("parts > 1")
    homes, _ = write_table(homes.select("key", "home", F.ceil(F.col("m") / TILE).cast("int").alias("pm"), F.ceil((F.col("m") - F.col("at_home")) / TILE).cast("int").alias("po")), "homes")
    own, _ = write_table(own.join(homes, "key"), "apart")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = own.where("component <> home").select("key", "id", "component", F.lit(True).alias("other"), part("po").alias("i"), every("pm").alias("j"))
    b = own.select("key", "id", "component", F.lit(False).alias("other"), every("po").alias("i"), part("pm").alias("j"))
    return a.union(b).join(sets.select("id", "s"), "id").groupBy("key", "i", "j").applyInArrow(_links_in_tile(similarity), "src long, dst long")


def similar_links(items: DataFrame, similarity: float, dense: int = DENSE, rounds: int = ROUNDS, *, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, keys) -> (src, dst) links whose components are those of all pairs that share a key and are similar.

    ``sets_of`` gives (id, shingles) for a table of ids; without it, ``items`` has a column ``shingles``. Only ids that
    share a key with another are asked for, so that sets of all others need not be kept. Rows of one id have equal sets.
    """
    met, _ = write_table(_met(items), "met")
    wanted = met.select("id").distinct()
    found = sets_of(wanted) if sets_of else items.select("id", "shingles").join(wanted, "id", "left_semi").groupBy("id").agg(F.any_value("shingles").alias("shingles"))
    sets, _ = write_table(found.select("id", F.col("shingles").alias("s")), "sets")
    crowds, _ = write_table(_crowds(met.join(sets.select("id", F.size("s").alias("n")).distinct(), "id").select("key", "id", "n")), "buckets")
    small, large = crowds.where(F.col("m") <= dense), crowds.where(F.col("m") > dense)
    links = [_measured(_pairs(small, similarity), sets, similarity).where("linked").select("src", "dst")]
    if large.isEmpty():
        return links[0]
    left = large
    for _ in range(rounds):
        stars = left.where("id <> star").select(F.col("star").alias("src"), F.col("id").alias("dst")).distinct()
        told, _ = write_table(fewer_files(_measured(stars, sets, similarity).distinct()), "stars")
        links.append(told.where("linked").select("src", "dst"))
        seen = left.join(told, (F.col("star") == F.col("src")) & (F.col("id") == F.col("dst"))).select("key", "id", "n", "linked", "d")
        left, _ = write_table(_crowds(seen.where("not linked").select("key", "id", "n")), "buckets")
        if left.isEmpty():
            break
    told, _ = write_table(fewer_files(reduce(DataFrame.union, links).distinct()), "links")
    apart, _ = write_table(_apart(large.select("key", "id"), connected_components(told), sets, similarity), "apart")
    return told.union(apart)


def links_between(items: DataFrame, components: DataFrame, similarity: float, radius: int, sets_of: Callable[[DataFrame], DataFrame], dense: int = DENSE) -> DataFrame:
    """(id, n, fp, keys) and (node, component) -> (src, dst) links between components: those of all pairs that share a key and are similar.

    ``n`` is the size of an id's set and ``fp`` its fingerprint, an array of longs. In buckets of few members, pairs whose fingerprints differ in more than ``radius`` bits are
    discarded before their sets are read; larger buckets are compared in tiles.
    """
    # a text has many keys and most of them alone, so only what meets takes its fingerprint along
    members = _met(items).join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    own, _ = write_table(members.join(sizes.select("key", "m"), "key").join(items.select("id", "n", "fp"), "id"), "between")
    a, b = own.where(F.col("m") <= dense).alias("a"), own.where(F.col("m") <= dense).alias("b")
    bits = F.aggregate(F.zip_with("a.fp", "b.fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component")))
    met = met.where(F.least("a.n", "b.n") >= similarity * F.greatest("a.n", "b.n")).where(bits <= radius)
    pairs, _ = write_table(fewer_files(met.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()), "pairs")
    large = own.where(F.col("m") > dense).select("key", "id")
    wanted = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).union(large.select("id")).distinct()
    sets, _ = write_table(sets_of(wanted).select("id", F.col("shingles").alias("s")), "sets")
    links = _measured(pairs, sets, similarity).where("linked").select("src", "dst")
    return links if large.isEmpty() else links.union(_apart(large, components, sets, similarity))
