"""Chat formatting after collapse of cumulative snapshots.

Logs often hold a conversation many times, each time a few turns longer. Every turn gets the hash of
the conversation up to it: a rolling polynomial over turn digests modulo 2^127 - 1, so the state of a run
of turns is two numbers and states of neighbouring runs combine. Turns are sorted by range of the whole
sort key, so their order does not depend on the partitions; each
partition rolls over its own turns, the driver combines one state per partition, and a second pass
adds what came before: no conversation has to fit a task to be hashed and collapsed. Rendering gathers a
maximal conversation into one row, as its text is one value. A conversation is dropped if its last hash,
at its number of turns, is an inner hash of a longer one (anti-join of distinct hashes), or if an equal
conversation has a smaller conv_id. The maximal ones are rendered.

Cases: turns sort by (turn, role, text), nulls first; a null role or text is its own value in the hash,
is rendered empty, and differs from an empty one; rows without conv_id are one conversation of their own; repeated rows are
repeated turns; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import shared_dir, write_table

MODULUS = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"turns").digest()[:15], "big")
TURN_START, TURN_END = "<|{role}|>\n", "<|end|>\n"

_State = tuple[int | None, int, int]  # conversation, turns, hash


def turn_digest(role: str | None, text: str | None) -> int:
    parts = [b"-" if x is None else b"+%d:" % len(x.encode("utf-8", "surrogatepass")) + x.encode("utf-8", "surrogatepass") for x in (role, text)]
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=15).digest(), "big") + 1


def _roll(batches: Iterator[pa.RecordBatch], state: _State | None) -> Iterator[tuple[pa.RecordBatch, list[int], list[str], _State]]:
    conv, n, h = state or (None, 0, 0)
    for b in batches:
        places, hashes = [], []
        for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if c != conv:
                conv, n, h = c, 0, 0
            n, h = n + 1, (h * BASE + turn_digest(role, text)) % MODULUS
            places.append(n)
            hashes.append(f"{h:032x}")
        yield b, places, hashes, (conv, n, h)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, prefix): place counts a conversation's turns from 1."""
    shared_dir(turns.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, whole, state = None, True, None
        for b, places, _, state in _roll(batches, None):
            convs = b.column("conv_id").to_pylist()
            if convs and first is None:
                first = (convs[0],)
            whole = whole and all(c == first[0] for c in convs)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) if i else pa.array([x], pa.int32()) for i, x in enumerate((TaskContext.get().partitionId(), str(first[0]), whole, str(state[0]), state[1], f"{state[2]:032x}"))], ["part", "first", "whole", "conv", "n", "h"])

    before: dict[int, _State] = {}
    carry: _State | None = None
    for r in sorted(rows.mapInArrow(ends, "part int, first string, whole boolean, conv string, n long, h string").collect()):  # one row per partition
        conv = None if r["conv"] == "None" else int(r["conv"])
        if carry is not None and r["first"] == str(carry[0]):
            before[r["part"]] = carry
        n, h = r["n"], int(r["h"], 16)
        if r["whole"] and r["part"] in before:
            h = (carry[2] * pow(BASE, n, MODULUS) + h) % MODULUS
            n += carry[1]
        carry = (conv, n, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, places, hashes, _ in _roll(batches, before.get(TaskContext.get().partitionId())):
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(places, pa.int64()), b.column("role"), b.column("text"), pa.array(hashes, pa.string())], ["conv_id", "place", "role", "text", "prefix"])

    return write_table(rows.mapInArrow(run, "conv_id long, place long, role string, text string, prefix string"), "prefixes")[0]


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): conversations that no longer one begins with, the smallest conv_id of equal ones; n_equal counts those."""
    ends = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by("prefix", "place").alias("prefix"))
    inner = prefixes.join(ends.select(F.col("conv_id").alias("c"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("c"))).where("place < n_turns").select("prefix", F.col("place").alias("n_turns")).distinct()
    distinct = ends.groupBy("prefix", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    return distinct.join(inner, ["prefix", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_equal")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, chat): maximal conversations, each turn between its marks."""
    prefixes = prefix_hashes(turns)
    kept = maximal(prefixes)
    start, end = TURN_START.split("{role}"), F.lit(TURN_END)
    turn = F.concat(F.lit(start[0]), F.coalesce("role", F.lit("")), F.lit(start[1]), F.coalesce("text", F.lit("")), F.lit("\n"), end)
    own = kept.select(F.col("conv_id").alias("c"), "n_turns", "n_equal")
    parts = prefixes.select("conv_id", "place", turn.alias("s")).join(own, F.col("conv_id").eqNullSafe(F.col("c")))
    chats = parts.groupBy("conv_id", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(F.struct("place", "s"))).alias("a"))
    return chats.select("conv_id", "n_turns", "n_equal", F.array_join(F.transform("a", lambda x: x["s"]), "").alias("chat"))


ORACLE_SQL = """
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations
), prefixes AS (
  SELECT *, md5(string_agg(CASE WHEN role IS NULL THEN '-' ELSE '+' || length(role) || ':' || role END || CASE WHEN text IS NULL THEN '-' ELSE '+' || length(text) || ':' || text END, '')
    OVER (PARTITION BY conv_id ORDER BY place)) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM numbered
), ends AS (
  SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM prefixes WHERE place = n_turns GROUP BY prefix, n_turns
), kept AS (
  SELECT * FROM ends e WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.prefix = e.prefix AND p.place = e.n_turns AND p.place < p.n_turns)
)
SELECT k.conv_id, k.n_turns, k.n_equal,
  string_agg('<|' || coalesce(p.role, '') || '|>' || chr(10) || coalesce(p.text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY p.place) AS chat
FROM kept k JOIN prefixes p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.n_turns, k.n_equal
"""
