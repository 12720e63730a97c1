"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c or more lie within a squared distance of 2 - 2c. A fixed random rotation
spreads it over all dimensions, which are split into blocks; by the pigeonhole principle a linked pair lies, in at
least one block, within that block's share of the budget (in proportion to its dimensions). Each
block is range-joined on its own: coordinates are cut at the quantiles of the spread that the rotation
gives, and a vector is sent to every cell that the ball of half the block's radius around it touches, so that two
vectors within the radius meet where their midpoint is. In a cell, pairs within the block's share are found by
blocked matrix products and verified by cosine in double precision over the vectors as stored; a pair
counts in its first block within the share, in the midpoint's cell, and nowhere else. A cell gives counts
of links and a spanning forest, not pairs. A cell of more than ``CROWD`` vectors, as a dense cluster makes one
however fine the cells are, is compared in tiles: its vectors are dealt to parts, and each pair of parts is a task of its own, so
no task holds more than about two parts. Cuts grow finer with the number of vectors of the largest label, so that a
cell keeps its size; equal vectors of a label are one, with their number.

Cases: a null label, and a vector that is null, empty, zero, or has a null or non-finite component, links with nothing; vectors of
different lengths do not link; rows that share a vec_id are vectors of their own; rows without vec_id link like others, and a
component without any has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import connected_components, write_table

COSINE = 0.98
BLOCK = 8
#: Vectors of one label in a cell, about, before cuts get finer.
CELL = 1000
#: Vectors that one task compares; larger cells become tiles of two halves of it.
CROWD = 4096
_SLACK = 1e-9
_TILE = 2048


@lru_cache(maxsize=8)
def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks_of(d: int) -> list[slice]:
    n = max(1, round(d / BLOCK))
    cuts = [round(i * d / n) for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=64)
def cuts_of(d: int, cells: int, size: int) -> tuple[np.ndarray, ...]:
    """Inner boundaries on each of a block's ``size`` coordinates, for ``cells`` cells or more in all.

    Coordinates take turns at one interval more; intervals are equally likely for a coordinate of a
    random unit vector, which is nearly normal.
    """
    parts, j = [1] * size, 0
    while np.prod(parts, dtype=float) < cells:
        parts[j % size] += 1
        j += 1
    x = np.linspace(-6, 6, 24001)
    mass = np.cumsum(np.exp(-x * x / 2))
    return tuple(np.interp(np.arange(1, n) / n, mass / mass[-1], x) / np.sqrt(d) for n in parts)


def cells_of(x: np.ndarray, cuts: tuple[np.ndarray, ...]) -> np.ndarray:
    """One number for the cell of each row."""
    code = np.zeros(len(x), np.int64)
    for j, c in enumerate(cuts):
        code = code * (len(c) + 1) + np.searchsorted(c, x[:, j], side="right")
    return code


def touched_cells(x: np.ndarray, cuts: tuple[np.ndarray, ...], radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells that balls of the radius around the rows touch."""
    rows, code, left = np.arange(len(x)), np.zeros(len(x), np.int64), np.full(len(x), radius * radius)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        low, high = np.concatenate(([-np.inf], c)), np.concatenate((c, [np.inf]))
        v = x[rows, j]
        far = np.maximum(np.maximum(low[None, :] - v[:, None], v[:, None] - high[None, :]), 0) ** 2
        near, interval = np.nonzero(far <= left[:, None])
        rows, code, left = rows[near], code[near] * len(low) + interval, left[near] - far[near, interval]
    return rows, code


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def spread(vectors: DataFrame, n_cells: int, cosine: float, with_vectors: bool = True) -> DataFrame:
    """(label, dim, block, cell, id, n, vec) for each cell that a vector is sent to. vec: its float32 components. Without vectors, (label, dim, block, cell) and how many a batch sends there."""

    def sent(part: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        v = _matrix(part.column("vec")).astype(np.float64)
        z = v / np.linalg.norm(v, axis=1, keepdims=True) @ rotation(d)
        for k, where in enumerate(blocks_of(d)):
            share = (2 - 2 * cosine + _SLACK) * (where.stop - where.start) / d
            yield k, *touched_cells(z[:, where], cuts_of(d, n_cells, where.stop - where.start), np.sqrt(share) / 2 + _SLACK)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                own = b.take(pa.array(np.flatnonzero(dims == d)))
                for i in range(0, own.num_rows, 4096):
                    yield d, own.slice(i, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part in parts(batches):
            for k, rows, cells in sent(part, d):
                for j in range(0, len(rows), 8192):
                    out = part.take(pa.array(rows[j : j + 8192]))
                    yield pa.RecordBatch.from_arrays([out.column("label"), out.column("dim"), pa.array(np.full(out.num_rows, k), pa.int32()), pa.array(cells[j : j + 8192], pa.int64()), out.column("id"), out.column("n"), out.column("vec")], ["label", "dim", "block", "cell", "id", "n", "vec"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part in parts(batches):
            labels = part.column("label").to_numpy()
            for k, rows, cells in sent(part, d):
                where, n = np.unique(np.column_stack((labels[rows], cells)), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(where[:, 0], pa.int32()), pa.array(np.full(len(n), d), pa.int32()), pa.array(np.full(len(n), k), pa.int32()), pa.array(where[:, 1], pa.int64()), pa.array(n, pa.int64())], ["label", "dim", "block", "cell", "members"])

    if not with_vectors:
        return vectors.mapInArrow(count, "label int, dim int, block int, cell long, members long")
    return vectors.mapInArrow(run, "label int, dim int, block int, cell long, id long, n long, vec binary")


def tiles(vectors: DataFrame, n_cells: int, cosine: float) -> DataFrame:
    """``spread`` with ``part``, ``i`` and ``j``: rows of (cell, i, j) meet; those of i and j differ in part, unless i = j. Most cells are one tile."""
    where = ["label", "dim", "block", "cell"]
    crowds = spread(vectors, n_cells, cosine, with_vectors=False).groupBy(*where).agg(F.sum("members").alias("members")).where(F.col("members") > CROWD)
    crowds, _ = write_table(crowds, "crowds")
    rows = spread(vectors, n_cells, cosine)
    if crowds.isEmpty():
        return rows.select("*", *[F.lit(0).alias(c) for c in ("part", "i", "j")])
    parts = F.coalesce(F.ceil(F.col("members") / (CROWD // 2)), F.lit(1)).cast("int")
    rows = rows.join(crowds, where, "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(*where, "id", "n", "vec", "part", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))


def links_in_cell(n_cells: int, cosine: float):
    """For applyInArrow over (label, dim, block, cell, i, j): (id, links, other) with counts of linked vectors, and the smallest id of those linked through each other here."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        d, block, cell = (k.as_py() for k in key[1:4])
        apart = key[4].as_py() != key[5].as_py()
        part = t.column("part").to_numpy()
        ids, weight = t.column("id").to_numpy(), t.column("n").to_numpy()
        v = _matrix(t.column("vec").combine_chunks()).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        z = v @ rotation(d)
        where, own = blocks_of(d), np.arange(len(ids))
        cuts = cuts_of(d, n_cells, where[block].stop - where[block].start)
        shares = [(2 - 2 * cosine + _SLACK) * (s.stop - s.start) / d for s in where]
        links, parent = np.zeros(len(ids), np.int64), own.copy()
        x = z[:, where[block]]
        square = (x * x).sum(axis=1)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a in range(0, len(ids), _TILE):
            for b in range(a, len(ids), _TILE):
                sa, sb = slice(a, a + _TILE), slice(b, b + _TILE)
                i, j = np.nonzero(square[sa, None] + square[None, sb] - 2 * x[sa] @ x[sb].T <= shares[block] + 1e-12)
                i, j = i + a, j + b
                new = (i < j) & (part[i] != part[j]) if apart else i < j
                i, j = i[new], j[new]
                for c in range(0, len(i), 1 << 16):
                    p, q = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                    good = np.einsum("ij,ij->i", v[p], v[q]) >= cosine
                    p, q = p[good], q[good]
                    first = np.full(len(p), -1)
                    for k in reversed(range(len(where))):
                        near = ((z[p, where[k]] - z[q, where[k]]) ** 2).sum(axis=1) <= shares[k]
                        first[near] = k
                    here = first == block
                    here[here] = cells_of((x[p[here]] + x[q[here]]) / 2, cuts) == cell
                    p, q = p[here], q[here]
                    np.add.at(links, p, weight[q])
                    np.add.at(links, q, weight[p])
                    for m, n in zip(p.tolist(), q.tolist()):
                        m, n = root(m), root(n)
                        if m != n:
                            parent[max(m, n)] = min(m, n)
        tops = np.array([root(i) for i in own], np.int64)
        some = links > 0
        return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some]), "other": pa.array(ids[tops[some]], pa.int64())})

    return run


def near_classes(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    vec = F.transform("embedding", lambda x: x.cast("float"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound = sound & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), vec.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    # the hash only spreads the rows: what is equal is told by the vectors
    rows = rows.withColumn("h", F.when(F.col("sound"), F.xxhash64("label", "v")))
    classes = rows.where("sound").groupBy("h", "label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low")).withColumn("id", F.monotonically_increasing_id())

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(x, np.float32).tobytes() for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(r) // 4 for r in raw], pa.int32()), pa.array(raw, pa.binary())], [*b.schema.names, "dim", "vec"])

    classes, _ = write_table(classes.mapInArrow(as_bytes, "h long, label int, v array<float>, n long, low long, id long, dim int, vec binary"), "vectors")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    n_cells = -(-most // CELL)
    cells = tiles(classes.drop("low", "h", "v"), n_cells, cosine).groupBy("label", "dim", "block", "cell", "i", "j").applyInArrow(links_in_cell(n_cells, cosine), "id long, links long, other long")
    found, _ = write_table(cells, "links")
    components = connected_components(found.where("id <> other").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(links, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left").select("h", "label", "v", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").select("h", "label", "v", "n_links", "component_id")
    out = rows.join(named, ["h", "label", "v"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
