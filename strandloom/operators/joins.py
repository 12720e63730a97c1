"""Joins of records with tables and with each other, unions, sorts and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.records import attribute


def annotate_from(left: DataFrame, right: DataFrame, on: dict[str, str] | None = None, update_id: bool = False, update_sequence: bool = False, update_qualities: bool = False) -> DataFrame:
    """Left outer join: the right record's annotations are added and win.

    ``on`` maps left attributes to right ones, compared as text (default: id). A left record without the
    key, or without a match, passes; several matches give several rows.
    """
    on = on or {"id": "id"}
    left_keys = {f"__k{i}": attribute(a) for i, a in enumerate(on)}
    r = right.select(*[attribute(b).alias(f"__r{i}") for i, b in enumerate(on.values())], F.col("annotations").alias("__a"), F.col("id").alias("__id"), F.col("sequence").alias("__s"), F.col("qualities").alias("__q"))
    same = reduce(lambda a, b: a & b, [F.col(f"__k{i}") == F.col(f"__r{i}") for i in range(len(on))])
    out = left.withColumns(left_keys).join(r, same, "left")
    new_keys = F.map_keys("__a")
    notes = F.when(F.col("__a").isNotNull(), F.map_concat(F.map_filter("annotations", lambda k, _: ~F.array_contains(new_keys, k)), "__a")).otherwise(F.col("annotations"))
    pick = lambda use, new, old: F.when(F.length(new) > 0, F.col(new)).otherwise(F.col(old)) if use else F.col(old)
    q = F.when(F.size("__q") > 0, F.col("__q")).otherwise(F.col("qualities")) if update_qualities else F.col("qualities")
    out = out.withColumns({"annotations": notes, "id": pick(update_id, "__id", "id"), "sequence": pick(update_sequence, "__s", "sequence"), "qualities": q})
    return out.select(*left.columns)


def pair_up(forward: DataFrame, reverse: DataFrame, order: str = "input_order") -> DataFrame:
    """The n-th record with the n-th: the mate is a struct column."""
    mate = reverse.select(F.col(order).alias(order), F.struct("id", "sequence", "qualities", "annotations").alias("mate"))
    return forward.join(mate, order)


def on_mate(df: DataFrame, f) -> DataFrame:
    """Apply an operator to the mates as if they were the records."""
    inner = df.withColumn("__self", F.struct("id", "sequence", "qualities", "annotations"))
    inner = inner.withColumns({c: F.col(f"mate.{c}") for c in ("id", "sequence", "qualities", "annotations")})
    out = f(inner).withColumn("mate", F.struct("id", "sequence", "qualities", "annotations"))
    return out.withColumns({c: F.col(f"__self.{c}") for c in ("id", "sequence", "qualities", "annotations")}).drop("__self")


def concat(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sort_records(df: DataFrame, by: str = "count", descending: bool = True) -> DataFrame:
    """By count or length; ties by id."""
    key = F.length("sequence") if by == "length" else F.col(by)
    return df.orderBy(key.desc() if descending else key, "id")


def head(df: DataFrame, n: int, skip: int = 0, order: str = "input_order") -> DataFrame:
    return df.orderBy(order).offset(skip).limit(n)


def sample(df: DataFrame, n: int, seed: int = 0, key: Column | None = None) -> DataFrame:
    """n records without replacement: those of the smallest hashes, so the same ones whatever the partitioning."""
    return df.orderBy(F.xxhash64(key if key is not None else F.col("id"), F.lit(seed)), "id").limit(n)
