"""Best-fit packing with certified bin counts.

Each document becomes its ids and an end id; only longer ones than the sequence length are cut, so
that all pieces but the first are full. Pieces are dealt to groups of bounded size by a hash, packed
by best-fit decreasing, and every group's bin count is held against a lower bound from dual-feasible
functions. A group with a gap is packed once more with bins filled exactly (``fill_exactly``), and the better packing
stands. Groups that meet the bound are done. From the others, the pieces of bins that are not full
are dealt anew, to fewer groups, and packed again, until the bound of the whole table is met or a
round brings nothing. What reaches the driver is one row per group and the histogram of lengths.

Cases: a null or empty text is its end id alone; repeated rows are packed as often as they occur; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import write_table
from strandloom.llm.tokens import encoder

LENGTH = 1024
#: Pieces in a group, on average: what one task sorts in memory.
GROUP = 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n tokens: all but the first are full."""
    first = n % length or length
    return [(0, min(first, n)), *((a, a + length) for a in range(first, n, length))]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """One row for each piece of each document, with the crc32 of its ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode_all(b.column("text").to_pylist())):
                ids += end
                rows += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(cut_points(len(ids) // 4, length))]
            doc, piece, start, size, crc = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. Room is looked up in a bit set, so an item costs the same whatever the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, k = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += size
        r -= size
        if not room[r]:
            mask |= 1 << r
        room[r].append(k)
    return bins, offsets, np.array(fill, np.int64)


def _partners(left: np.ndarray, room: int) -> list[int]:
    """One or two lengths, of those that are left, that fill the room to its end; empty if there are none."""
    if left[room]:
        return [room]
    both = np.flatnonzero((left[1:room] > 0) & (left[room - 1 : 0 : -1] > 0)) + 1
    both = both[(2 * both != room) | (left[both] > 1)]
    return [int(both[-1]), room - int(both[-1])] if len(both) else []


def fill_exactly(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``best_fit_decreasing``, but every bin begins with the longest piece left and is filled to its end by one or two others if such are left, else by the longest that fits."""
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=capacity + 1)
    of_length = np.cumsum(left[::-1])[::-1] - left  # where the pieces of a length begin in ``order``
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []

    def put(size: int) -> None:
        left[size] -= 1
        k = order[of_length[size] + left[size]]
        bins[k], offsets[k] = len(fill) - 1, fill[-1]
        fill[-1] += size

    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return bins, offsets, np.array(fill, np.int64)
        fill.append(0)
        put(longest)
        while fill[-1] < capacity:
            room = capacity - fill[-1]
            found = _partners(left, room)
            if not found:
                found = np.flatnonzero(left[: room + 1])[-1:].tolist()
            if not found:
                break
            for size in found:
                put(size)


def lower_bound(histogram: np.ndarray, capacity: int = LENGTH) -> int:
    """The best bound on the number of bins over two families of dual-feasible functions; histogram[x]: items of length x."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((x * histogram).sum()) // capacity)
    for cut_at in range(1, capacity // 2 + 1):  # more than capacity - cut_at counts whole, less than cut_at nothing
        f = np.where(x > capacity - cut_at, capacity, np.where(x < cut_at, 0, x))
        best = max(best, -(-int((f * histogram).sum()) // capacity))
    for k in range(1, 64):  # rounding down to k-ths, whole (k+1)-ths stay
        whole = x * (k + 1) % capacity == 0
        f = np.where(whole, x * k, x * (k + 1) // capacity * capacity)  # over k * capacity
        best = max(best, -(-int((f * histogram).sum()) // (k * capacity)))
    return best


def _pack_group(capacity: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1], capacity)
        if len(fill) > bound:
            other = fill_exactly(lengths, capacity)
            if len(other[2]) < len(fill):
                bins, offsets, fill = other
        gap = len(fill) - bound
        out = t.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        seq = (key[0].as_py() << 32) + bins
        for name, col in (("sequence_id", seq), ("offset", offsets), ("fill", fill[bins])):
            out = out.append_column(name, pa.array(col, pa.int64()))
        return out.append_column("gap", pa.array(np.full(len(bins), gap), pa.int64()))

    return run


def _pack(pieces: DataFrame, n: int, first_group: int, capacity: int) -> tuple[DataFrame, int, int]:
    """(packed pieces, bins, groups): n pieces dealt to groups from ``first_group`` on."""
    groups = max(1, -(-n // GROUP))
    # the place in the written table parts equal rows, and is the same when a task runs again
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)) + F.lit(first_group))
    out, _ = write_table(dealt.groupBy("g").applyInArrow(_pack_group(capacity), PIECES + ", sequence_id long, offset long, fill long, gap long"), "packed")
    return out, out.where(F.col("offset") == 0).count(), groups


def pack(pieces: DataFrame, capacity: int = LENGTH, max_rounds: int = 4) -> DataFrame:
    """Pieces with sequence_id and offset, gapless from 0 in each sequence."""
    pieces, _ = write_table(pieces, "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[r["length"]] = r["count"]
    n, bound = int(histogram.sum()), lower_bound(histogram, capacity)
    packed, total, used = _pack(pieces, n, 0, capacity)
    done = []
    columns = [*PIECES.replace(" long", "").replace(" int", "").split(", "), "sequence_id", "offset"]
    for _ in range(max_rounds):
        if total <= bound:
            break
        loose = (F.col("gap") > 0) & (F.col("fill") < capacity)
        again = packed.where(loose)
        before = again.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).first()
        if before["n"] == 0:
            break
        better, bins, groups = _pack(again.select(*columns[:5]), before["n"], used, capacity)
        if bins >= before["bins"]:
            break
        done.append(packed.where(~loose))
        packed, total, used = better, total - before["bins"] + bins, used + groups
    for d in done:
        packed = packed.union(d)
    return packed.select(*columns)
