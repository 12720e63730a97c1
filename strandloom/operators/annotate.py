"""Editing of records: each function returns a DataFrame; ``where`` limits it to the records that match, the others pass unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.functions.expressions import value
from strandloom.records import qualities_of, raw_attribute, set_attributes


def _edit(df: DataFrame, where: Column | None, **columns: Column) -> DataFrame:
    if where is not None:
        sure = F.coalesce(where, F.lit(False))
        columns = {k: F.when(sure, v).otherwise(F.col(k)) for k, v in columns.items()}
    return df.withColumns(columns)


def clear(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Remove all annotations and histograms; the count goes back to 1."""
    return _edit(df, where, annotations=F.create_map().cast("map<string,string>"), merged=F.create_map().cast("map<string,map<string,bigint>>"), count=F.lit(1).cast("bigint"))


def delete_keys(df: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    return _edit(df, where, annotations=F.map_filter("annotations", lambda k, _: ~k.isin(*keys)))


def keep_keys(df: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    return _edit(df, where, annotations=F.map_filter("annotations", lambda k, _: k.isin(*keys)))


def rename_key(df: DataFrame, old: str, new: str, where: Column | None = None) -> DataFrame:
    """Only in records that have the old key; a former value of the new key goes."""
    has = F.map_contains_key("annotations", old)
    others = F.map_filter("annotations", lambda k, _: ~k.isin(old, new))
    renamed = F.when(has, F.map_concat(others, F.create_map(F.lit(new), raw_attribute(old)))).otherwise(F.col("annotations"))
    return _edit(df, where, annotations=renamed)


def set_keys(df: DataFrame, expressions: dict[str, str], where: Column | None = None) -> DataFrame:
    """Write the values of expressions, in the order given: later ones see earlier ones."""
    for key, text in expressions.items():
        if key in ("id", "sequence", "definition"):
            df = _edit(df, where, **{key: value(text).cast("string")})
        elif key == "count":
            df = _edit(df, where, count=F.greatest(value(text).try_cast("bigint"), F.lit(1)))
        else:
            df = set_attributes(df, {key: value(text)}, where)
    return df


def set_id(df: DataFrame, expression: str, where: Column | None = None) -> DataFrame:
    return set_keys(df, {"id": expression}, where)


def add_length(df: DataFrame, key: str = "seq_length", where: Column | None = None) -> DataFrame:
    return set_attributes(df, {key: F.length("sequence")}, where)


def number(df: DataFrame, key: str = "seq_number", order: str = "input_order") -> DataFrame:
    """Numbers from 1 in input order, rows without one last.

    Rows are dealt to ranges and numbered within them; what precedes a range comes from one count per range, so no task
    sees all rows. The bounds are taken once, from a sample, and are literals in the counts and in the rows: ranges that
    Spark takes differ between two jobs. Every row is counted and numbered, whatever the bounds.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = sorted(r[0] for r in df.select(order).where(F.col(order).isNotNull()).orderBy(F.rand()).limit(8 * parts).collect())
    bounds = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []
    kind = df.schema[order].dataType
    above = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    dealt = df.withColumn("__part", F.when(F.col(order).isNull(), len(bounds) + 1).otherwise(above))
    sizes = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())  # one row per range
    before, total = [], 0
    for part, n in sizes:
        before += [F.lit(part), F.lit(total).cast("bigint")]
        total += n
    offset = F.create_map(*before)[F.col("__part")] if before else F.lit(0).cast("bigint")
    at = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return set_attributes(dealt.withColumn("__at", at).withColumn("__number", offset + F.col("__at")), {key: F.col("__number")}).drop("__part", "__at", "__number")


def cut(df: DataFrame, start: int | None = None, end: int | None = None, where: Column | None = None) -> DataFrame:
    """Bases start to end, counted from 1; negative ones count from the end, None is open."""
    n = F.length("sequence")
    a = F.lit(1) if start is None else F.lit(start) if start > 0 else n + start + 1
    b = n if end is None else F.least(F.lit(end), n) if end > 0 else n + end + 1
    a = F.greatest(a, F.lit(1))
    size = F.greatest(b - a + 1, F.lit(0))
    return _edit(df, where, sequence=F.substr("sequence", a, size), qualities=F.slice("qualities", a, size))


def subsequence(df: DataFrame, start: int, end: int, circular: bool = False) -> DataFrame:
    """Bases from ``start`` (0-based) up to ``end``; the id gets ``_sub[start+1..end]``. Circular ones may begin after they end."""
    if start < 0 or end < 0 or start >= end and not circular:
        raise ValueError("the bounds of a subsequence are positive and in order, unless it is circular")
    if start < end:
        seq, q = F.substr("sequence", F.lit(start + 1), F.lit(end - start)), F.slice("qualities", start + 1, end - start)
    else:
        seq = F.concat(F.substr("sequence", F.lit(start + 1)), F.substr("sequence", F.lit(1), F.lit(end)))
        q = F.concat(F.slice("qualities", F.lit(start + 1), F.greatest(F.size("qualities") - start, F.lit(0))), F.slice("qualities", 1, end))
    fits = F.assert_true(F.length("sequence") >= F.lit(max(start + 1, end)), F.lit("the subsequence ends beyond its sequence"))
    return df.withColumns({"sequence": F.coalesce(fits.cast("string"), seq), "qualities": q, "id": F.concat("id", F.lit(f"_sub[{start + 1}..{end}]"))})


def reverse_complement(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Sequence and qualities reversed; positions of pairing mismatches are counted from the other end."""
    flipped = F.to_json(F.transform_values(F.from_json(raw_attribute("pairing_mismatches"), "map<string,int>"), lambda _, p: F.length("sequence") - p + 1))
    notes = F.when(flipped.isNotNull(), F.map_concat(F.map_filter("annotations", lambda k, _: k != "pairing_mismatches"), F.create_map(F.lit("pairing_mismatches"), flipped))).otherwise(F.col("annotations"))
    return _edit(df, where, annotations=notes, sequence=S.revcomp("sequence"), qualities=F.reverse("qualities"))


def concatenate(df: DataFrame, other: str, other_qualities: str | None = None) -> DataFrame:
    """Append the sequence of a column, with its qualities if both sides have some."""
    q = F.when(F.col("qualities").isNotNull() & F.col(other_qualities).isNotNull(), F.concat("qualities", other_qualities)) if other_qualities else F.lit(None)
    return df.withColumns({"qualities": q, "sequence": F.concat("sequence", other)})


def fragment(df: DataFrame, min_size: int, length: int, overlap: int) -> DataFrame:
    """Sequences longer than ``min_size`` as overlapping windows, a row each; the id gets the window's place."""
    long = df.where(F.length("sequence") > min_size).withColumn("__f", F.explode(S.fragment("sequence", length, overlap)))
    place = F.format_string("%s_frg[%d..%d]", "id", (F.col("__f.start") + 1).cast("int"), (F.col("__f.start") + F.length("__f.sequence")).cast("int"))
    cut_up = long.withColumns({"id": place, "qualities": F.slice("qualities", (F.col("__f.start") + 1).cast("int"), F.length("__f.sequence")), "sequence": F.col("__f.sequence")}).drop("__f")
    return df.where(F.length("sequence") <= min_size).unionByName(cut_up)


def demerge(df: DataFrame, slot: str) -> DataFrame:
    """One row per value of a histogram: the slot becomes an attribute and the weight the count; rows without the histogram pass."""
    own = F.try_element_at("merged", F.lit(slot))
    out = df.withColumn("__own", own).select("*", F.explode_outer("__own").alias("__value", "__weight"))
    out = set_attributes(out, {slot: F.col("__value")})
    return out.withColumns({"count": F.coalesce("__weight", "count"), "merged": F.map_filter("merged", lambda k, _: k != slot)}).drop("__own", "__value", "__weight")


def merge_slot(df: DataFrame, slot: str, weight: Column | None = None, na: str = "NA") -> DataFrame:
    """Histogram of one value made of an attribute, unless the record has the histogram already."""
    from strandloom.records import attribute

    made = F.create_map(F.lit(slot), F.create_map(F.coalesce(attribute(slot), F.lit(na)), F.coalesce(weight, F.col("count")) if weight is not None else F.col("count")))
    return df.withColumn("merged", F.when(F.map_contains_key("merged", slot), F.col("merged")).otherwise(F.map_concat("merged", made)))


def count_literals(df: DataFrame, patterns: list[str], slot: str = "literal") -> DataFrame:
    """Numbers of hits of literal patterns, overlapping ones too, on both strands and on each; only where there are any."""
    def hits(s: Column) -> Column:
        one = [(F.size(F.split(s, f"(?={p.lower()})")) - 1 + F.when(F.startswith(s, F.lit(p.lower())), 1).otherwise(0)).cast("bigint") for p in patterns]
        return sum(one[1:], one[0]) if one else F.lit(0).cast("bigint")

    forward, reverse = hits(F.lower("sequence")), hits(S.revcomp("sequence"))
    positive = lambda n: F.when(n > 0, n)
    return set_attributes(df, {slot: positive(forward + reverse), f"{slot}_Fwd": positive(forward), f"{slot}_Rev": positive(reverse)})


def quality_text(shift: int = 33) -> Column:
    return F.array_join(F.transform(qualities_of(), lambda q: F.char(F.least(q.cast("int"), F.lit(93)) + shift)), "")
