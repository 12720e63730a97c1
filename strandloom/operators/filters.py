"""Predicates over records, and the filter operators.

A predicate is a boolean Column that is never null, or None, which means no condition: ``all_of`` and
``any_of`` leave None out, and the negation of None is None.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.expressions import predicate
from strandloom.functions.sequences import iupac_regex, revcomp
from strandloom.records import attribute, has_attribute

Predicate = Column | None


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def all_of(*predicates: Predicate) -> Predicate:
    some = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, some) if some else None


def any_of(*predicates: Predicate) -> Predicate:
    some = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a | b, some) if some else None


def exactly_one(a: Predicate, b: Predicate) -> Predicate:
    if a is None or b is None:
        return a if b is None else b
    return a != b


def negated(p: Predicate) -> Predicate:
    return None if p is None else ~_sure(p)


def length_between(low: int | None = None, high: int | None = None) -> Predicate:
    n = F.length("sequence")
    return all_of(None if low is None else _sure(n >= low), None if high is None else _sure(n <= high))


def count_between(low: int | None = None, high: int | None = None) -> Predicate:
    n = F.coalesce(F.col("count"), F.lit(1))
    return all_of(None if low is None else n >= low, None if high is None else n <= high)


def in_samples(n: int, slot: str = "sample") -> Column:
    """The slot's histogram has at least n values."""
    return _sure(F.size(F.try_element_at("merged", F.lit(slot))) >= n)


def attribute_exists(*keys: str) -> Predicate:
    return all_of(*[has_attribute(k) for k in keys])


def attribute_matches(patterns: dict[str, str]) -> Predicate:
    """Case-sensitive search in the attributes' text; an absent attribute does not match."""
    return all_of(*[_sure(attribute(k).rlike(p)) for k, p in patterns.items()])


def sequence_matches(*patterns: str) -> Predicate:
    """Search that ignores case; several patterns all have to match."""
    return all_of(*[_sure(F.col("sequence").rlike(f"(?i){p}")) for p in patterns])


def definition_matches(*patterns: str, ignore_case: bool = False) -> Predicate:
    return all_of(*[_sure(F.col("definition").rlike(("(?i)" if ignore_case else "") + p)) for p in patterns])


def id_matches(*patterns: str, ignore_case: bool = False) -> Predicate:
    return all_of(*[_sure(F.col("id").rlike(("(?i)" if ignore_case else "") + p)) for p in patterns])


def expression(*texts: str) -> Predicate:
    """Boolean expressions; a record on which one fails is not matched."""
    return all_of(*[predicate(t) for t in texts])


def pattern_matches(pattern: str, errors: int = 0, indels: bool = False, both_strands: bool = True) -> Column:
    """IUPAC pattern with at most ``errors`` errors. Without errors this is a regular expression in generated code; with errors an Arrow kernel."""
    if errors == 0:
        found = F.col("sequence").rlike(iupac_regex(pattern))
        return _sure(found | revcomp("sequence").rlike(iupac_regex(pattern)) if both_strands else found)
    from strandloom.operators.patterns import any_hit

    return _sure(any_hit(pattern, errors, indels, both_strands)(F.col("sequence")))


def selection(
    min_length: int | None = None,
    max_length: int | None = None,
    min_count: int | None = None,
    max_count: int | None = None,
    taxonomy: Predicate = None,
    expressions: Iterable[str] = (),
    sequence: Iterable[str] = (),
    definition: Iterable[str] = (),
    identifier: Iterable[str] = (),
    has: Iterable[str] = (),
    attributes: dict[str, str] | None = None,
    approximate: Predicate = None,
    inverse: bool = False,
) -> Predicate:
    """The conjunction of all conditions, cheap ones first; ``inverse`` negates it as a whole."""
    p = all_of(
        length_between(min_length, max_length), count_between(min_count, max_count), taxonomy, expression(*expressions), sequence_matches(*sequence),
        definition_matches(*definition), id_matches(*identifier), attribute_exists(*has), attribute_matches(attributes or {}), approximate,
    )
    return negated(p) if inverse else p


def keep(df: DataFrame, p: Predicate) -> DataFrame:
    return df if p is None else df.where(_sure(p))


def divide(df: DataFrame, p: Predicate) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded); together they are all rows."""
    return (df, df.where(F.lit(False))) if p is None else (df.where(_sure(p)), df.where(~_sure(p)))


def keep_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Semi join with a list of identifiers; the optimizer broadcasts it if it is small."""
    return df.join(ids.select(F.col(ids.columns[0]).cast("string").alias(column)).distinct(), column, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).cast("string").alias(column)).distinct(), column, "left_anti")


PAIRED = ("forward", "reverse", "and", "or", "andnot", "xor")


def paired(forward: Column, reverse: Column, mode: str) -> Column:
    """Combine a predicate's values on the two mates of a pair."""
    f, r = _sure(forward), _sure(reverse)
    if mode not in PAIRED:
        raise ValueError(f"the paired mode is one of {PAIRED}")
    return {"forward": f, "reverse": r, "and": f & r, "or": f | r, "andnot": f & ~r, "xor": f != r}[mode]
