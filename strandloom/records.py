"""The sequence record as columns, and its open annotations.

Every operator takes and returns DataFrames of RECORD columns; further columns pass through.
``annotations`` maps a key to the JSON text of its value, so a record may carry anything; hot keys are
promoted to columns of their own with ``with_attributes``, so that Catalyst prunes and pushes them.
``merged`` holds abundance histograms: slot -> value -> weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("sequence", T.StringType()),
    T.StructField("qualities", T.ArrayType(T.ByteType())),
    T.StructField("definition", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("taxid", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("input_order", T.LongType()),
    T.StructField("merged", T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))),
    T.StructField("annotations", T.MapType(T.StringType(), T.StringType())),
])
DEFAULT_QUALITY = 40
NA = "NA"


def as_records(df: DataFrame) -> DataFrame:
    """Fill what ``df`` lacks of RECORD; sequences go to lower case and counts are at least 1."""
    out = df
    for f in RECORD.fields:
        if f.name not in df.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    own = {
        "sequence": F.lower("sequence"),
        "count": F.greatest(F.coalesce(F.col("count").cast("long"), F.lit(1)), F.lit(1)),
        "annotations": F.coalesce("annotations", F.create_map().cast(RECORD["annotations"].dataType)),
        "merged": F.coalesce("merged", F.create_map().cast(RECORD["merged"].dataType)),
    }
    return out.withColumns(own).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD.fields], *[c for c in df.columns if c not in RECORD.names])


def qualities_of(q: str = "qualities", s: str = "sequence") -> Column:
    """Qualities, 40 everywhere if there are none."""
    return F.coalesce(F.col(q), F.array_repeat(F.lit(DEFAULT_QUALITY).cast("tinyint"), F.length(s)))


def raw_attribute(key: str) -> Column:
    """JSON text of an annotation, null if absent."""
    return F.try_element_at(F.col("annotations"), F.lit(key))


def attribute(key: str, kind: str = "string") -> Column:
    """An attribute as a typed value: the record's own columns first, then annotations; null if absent or not of the kind."""
    if key in ("id", "sequence", "definition", "source", "taxid"):
        return F.col(key).try_cast(kind)
    if key in ("count", "qualities"):
        return F.col(key).cast(kind)
    if key.startswith("merged_"):
        slot = F.try_element_at(F.col("merged"), F.lit(key.removeprefix("merged_")))
        return F.to_json(slot) if kind == "string" else slot
    text = raw_attribute(key)
    if kind == "string":
        return F.get_json_object(text, "$")
    if kind.startswith(("array", "map", "struct")):
        return F.from_json(text, kind)
    if kind in ("boolean", "bool"):
        return truth(F.get_json_object(text, "$"))
    value = F.get_json_object(text, "$").try_cast("double")
    return value if kind == "double" else F.get_json_object(text, "$").try_cast(kind) if kind != "bigint" else value.try_cast("bigint")


def has_attribute(key: str) -> Column:
    """True for an annotation key, its value JSON null or not; the record's own columns do not count."""
    if key == "count":
        return F.lit(True)
    if key.startswith("merged_"):
        return F.map_contains_key("merged", key.removeprefix("merged_"))
    return F.coalesce(F.map_contains_key("annotations", key), F.lit(False))


def truth(text: Column) -> Column:
    """Strings as booleans: numbers but zero, and true, yes, on, t of any case; everything else is false."""
    number = text.try_cast("double")
    return F.when(text.isNull(), F.lit(False)).when(number.isNotNull(), number != 0).otherwise(F.lower(text).isin("true", "yes", "on", "t"))


def lenient_int(text: Column) -> Column:
    """Truncates decimals; a malformed text is 0."""
    return F.coalesce(text.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def with_attributes(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Promote annotations to typed columns of the same names."""
    return df.withColumns({k: attribute(k, kind) for k, kind in kinds.items()})


def set_attributes(df: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Write annotations; a null value leaves the key as it is. ``where``: only in those records."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), _json(v).alias("value")) for k, v in values.items()])
    new = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    if where is not None:
        new = F.when(F.coalesce(where, F.lit(False)), new).otherwise(F.create_map().cast("map<string,string>"))
    keys = F.map_keys(new)
    kept = F.map_filter("annotations", lambda k, _: ~F.array_contains(keys, k))
    return df.withColumn("annotations", F.map_concat(kept, new))


def _json(value: Column) -> Column:
    """JSON text of any value: what to_json writes for the one field of a struct."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "true"})
    return F.when(value.isNotNull(), F.substr(text, F.lit(6), F.length(text) - 6))


def annotation_keys() -> Column:
    """Keys of the record's annotations, sorted."""
    return F.array_sort(F.map_keys("annotations"))
