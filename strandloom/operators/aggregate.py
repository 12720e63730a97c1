"""Dereplication, histograms, counts, summaries, matrices and grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.records import attribute


def dereplicate(df: DataFrame, categories: list[str] | None = None, merge: list[str] | None = None, na: str = "NA", drop_singletons: bool = False, keep_attributes: list[str] | None = None) -> DataFrame:
    """One record per distinct sequence (and category values).

    Counts add up; the id of the first record by input order stays. For each slot in ``merge``
    (``name`` or ``name:weight_attribute``) the values' weights add up to a histogram, whether they come as
    attributes or as histograms. Another attribute survives only if every record of the group has it with
    the same value; qualities go. ``keep_attributes`` names the attributes to look at, which avoids the
    pass over all keys. All aggregates combine on the map side; a hot sequence is pre-aggregated.
    """
    categories, merge = categories or [], merge or []
    keys = {f"__c{i}": F.coalesce(attribute(c), F.lit(na)) for i, c in enumerate(categories)}
    base = df.withColumns(keys).withColumn("__g", F.struct("sequence", *keys))
    slots = [(m.partition(":")[0], m.partition(":")[2]) for m in merge]
    gone = [s for s, _ in slots] + categories
    first = F.struct(F.coalesce("input_order", F.lit(0)).alias("o"), "id")
    one = {c: F.when((F.min(c).eqNullSafe(F.max(c))) & (F.count(c) == F.count(F.lit(1))), F.min(c)).alias(c) for c in ("definition", "taxid", "source")}
    out = base.groupBy("__g").agg(F.min(first).alias("__first"), F.sum("count").alias("count"), F.count(F.lit(1)).alias("__n"), *one.values())
    out = _with_common_attributes(out, base, gone, keep_attributes)
    for i, (slot, weight) in enumerate(slots):
        hist = histogram(base, "__g", slot, weight or None, na).withColumnRenamed("hist", f"__h{i}")
        out = out.join(hist, "__g", "left")
    merged = F.map_from_entries(F.array(*[F.struct(F.lit(s).alias("key"), F.col(f"__h{i}").alias("value")) for i, (s, _) in enumerate(slots)])) if slots else F.create_map()
    notes = F.col("annotations")
    if categories:
        own = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.to_json(F.struct(F.col(f"__g.__c{i}").alias("v"))).alias("value")) for i, c in enumerate(categories)]))
        notes = F.map_concat(notes, F.transform_values(own, lambda _, v: F.substr(v, F.lit(6), F.length(v) - 6)))
    out = out.select(
        F.col("__first.id").alias("id"), F.col("__g.sequence").alias("sequence"), F.lit(None).cast("array<tinyint>").alias("qualities"), "definition", "count", "taxid", "source",
        F.col("__first.o").alias("input_order"), merged.cast("map<string,map<string,bigint>>").alias("merged"), notes.alias("annotations"),
    )
    return out.where("count > 1") if drop_singletons else out


def _with_common_attributes(groups: DataFrame, rows: DataFrame, gone: list[str], names: list[str] | None) -> DataFrame:
    """Annotations that all records of a group share."""
    if names is not None:
        columns = [n for n in names if n not in gone]
        if not columns:
            return groups.withColumn("annotations", F.create_map().cast("map<string,string>"))
        values = rows.select("__g", *[F.try_element_at("annotations", F.lit(n)).alias(f"__a{i}") for i, n in enumerate(columns)])
        same = values.groupBy("__g").agg(*[F.when((F.min(f"__a{i}") == F.max(f"__a{i}")) & (F.count(f"__a{i}") == F.count(F.lit(1))), F.min(f"__a{i}")).alias(f"__a{i}") for i in range(len(columns))])
        entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"__a{i}").alias("value")) for i, n in enumerate(columns)]), lambda e: e["value"].isNotNull())
        return groups.join(same.select("__g", F.map_from_entries(entries).alias("annotations")), "__g")
    long = rows.select("__g", F.explode("annotations").alias("k", "v"))
    if gone:
        long = long.where(~F.col("k").isin(*gone))
    per_key = long.groupBy("__g", "k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"), F.max("v").alias("w")).where("v = w")
    kept = per_key.join(groups.select("__g", F.col("__n").alias("n")), ["__g", "n"])
    maps = kept.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("annotations"))
    return groups.join(maps, "__g", "left").withColumn("annotations", F.coalesce("annotations", F.create_map().cast("map<string,string>")))


def slot_weights(df: DataFrame, slot: str, weight: str | None = None, na: str = "NA") -> DataFrame:
    """All columns, and (value, weight) for each entry of the slot: the histogram's, else one of the attribute's value."""
    w = F.coalesce(attribute(weight, "bigint"), F.lit(0)) if weight else F.col("count")
    single = F.create_map(F.coalesce(attribute(slot), F.lit(na)), w.cast("bigint"))
    return df.select("*", F.explode(F.coalesce(F.try_element_at("merged", F.lit(slot)), single)).alias("value", "weight"))


def histogram(df: DataFrame, key: str, slot: str, weight: str | None = None, na: str = "NA") -> DataFrame:
    """(key, hist): the slot's weights added up for each key. Sums come first, so only distinct values of a key are gathered."""
    sums = slot_weights(df, slot, weight, na).groupBy(key, "value").agg(F.sum("weight").alias("weight"))
    return sums.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "weight")))).alias("hist"))


def count_records(df: DataFrame) -> DataFrame:
    """(variants, reads, symbols)."""
    return df.agg(F.count(F.lit(1)).alias("variants"), F.coalesce(F.sum("count"), F.lit(0)).alias("reads"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).cast("bigint").alias("symbols"))


def attribute_census(df: DataFrame) -> DataFrame:
    """(key, kind, records): how many records have each attribute, as scalar, map or vector."""
    kind = F.when(F.startswith("v", F.lit("{")), "map").when(F.startswith("v", F.lit("[")), "vector").otherwise("scalar")
    notes = df.select(F.explode("annotations").alias("key", "v")).groupBy("key", kind.alias("kind")).agg(F.count(F.lit(1)).alias("records"))
    hists = df.select(F.explode(F.map_keys("merged")).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("records"))
    counts = df.agg(F.count(F.lit(1)).alias("records")).select(F.lit("count").alias("key"), F.lit("scalar").alias("kind"), "records")
    return notes.union(hists.select(F.concat(F.lit("merged_"), "slot"), F.lit("map"), "records")).union(counts)


def sample_summary(df: DataFrame, slot: str = "sample", na: str = "NA", status: str = "clean_status") -> DataFrame:
    """(sample, reads, variants, singletons, bad): bad counts variants that are internal in the sample, null unless every record has a status."""
    all_clean = df.agg(F.coalesce(F.bool_and(F.map_contains_key("annotations", status)), F.lit(False)).alias("clean"))
    internal = F.try_element_at(F.from_json(F.try_element_at("annotations", F.lit(status)), "map<string,string>"), F.col("value")) == "i"
    per = slot_weights(df, slot, None, na).groupBy(F.col("value").alias("sample")).agg(F.sum("weight").alias("reads"), F.count(F.lit(1)).alias("variants"), F.count_if(F.col("weight") == 1).alias("singletons"), F.count_if(internal).alias("bad"))
    return per.join(all_clean).select("sample", "reads", "variants", "singletons", F.when(F.col("clean"), F.col("bad")).alias("bad"))


def map_sums(df: DataFrame, slot: str) -> DataFrame:
    """(value, weight): a histogram summed over all records."""
    return df.select(F.explode(F.try_element_at("merged", F.lit(slot))).alias("value", "weight")).groupBy("value").agg(F.sum("weight").alias("weight"))


def matrix_long(df: DataFrame, slot: str = "sample") -> DataFrame:
    """(id, sample, count): the non-empty cells."""
    return df.select("id", F.explode(F.try_element_at("merged", F.lit(slot))).alias("sample", "count"))


def matrix(df: DataFrame, slot: str = "sample", transpose: bool = True, na: int | str = 0, strict: bool = True, max_columns: int = 10_000) -> DataFrame:
    """Samples x records (``transpose``), or records x samples, with sorted columns. In strict mode an id that occurs twice is an error."""
    cells = matrix_long(df, slot)
    rows, columns = ("sample", "id") if transpose else ("id", "sample")
    names = sorted(r[0] for r in cells.select(columns).distinct().limit(max_columns + 1).collect())
    if len(names) > max_columns:
        raise ValueError(f"a matrix of more than {max_columns} columns: use the long form")
    value = F.sum("count")
    if strict:
        value = F.when(F.count(F.lit(1)) <= 1, F.sum("count")).otherwise(F.raise_error(F.lit("an id occurs twice")).cast("bigint"))
    return cells.groupBy(rows).pivot(columns, names).agg(value).fillna(na)


def class_attribute(key: str, na: str = "NA") -> Column:
    return F.coalesce(attribute(key), F.lit(na))


def class_pair(a: str, b: str, na: str = "NA") -> Column:
    return F.concat_ws("_", class_attribute(a, na), class_attribute(b, na))


def class_hash(n: int) -> Column:
    """crc32 of the sequence modulo n."""
    return F.pmod(F.crc32(F.col("sequence").cast("binary")), F.lit(n))


def class_predicate(p: Column) -> Column:
    return F.coalesce(p, F.lit(False)).cast("string")


def class_composite(*classes: Column) -> Column:
    return F.concat_ws(":", *[c.cast("string") for c in classes])


def class_rotate(n: int, order: str = "input_order") -> Column:
    """Round robin over n batches by input order."""
    return F.pmod(F.col(order), F.lit(n)) + 1


def distribute(df: DataFrame, path: str, key: Column, directory: Column | None = None, form: str = "parquet") -> None:
    """Write one folder per class, below one per directory class; a hot class is dealt over several files."""
    parts = ["class"] if directory is None else ["directory", "class"]
    out = df.withColumn("class", key)
    if directory is not None:
        out = out.withColumn("directory", directory)
    out.repartition(*parts, F.pmod(F.xxhash64("id", "sequence"), F.lit(16))).write.partitionBy(*parts).format(form).mode("append").save(path)
