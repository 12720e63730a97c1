"""Annotations in title lines: JSON objects, or ``key=value;`` pairs."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.records import RECORD

_PAIR = re.compile(r"\s*([A-Za-z_][\w.-]*)=((?:\{[^}]*\}|\[[^\]]*\]|\"[^\"]*\"|'[^']*'|[^;{\[\"'])*);\s*")


def _plain(text: str) -> object:
    t = text.strip()
    if t in ("True", "true", "T", "False", "false", "F"):
        return t[0] in "Tt"
    try:
        return int(t)
    except ValueError:
        pass
    try:
        return float(t)
    except ValueError:
        pass
    if t[:1] in "{[\"'":
        try:
            v = ast.literal_eval(t)
            return {str(k): x for k, x in v.items()} if isinstance(v, dict) else v
        except (ValueError, SyntaxError):
            return t.strip("\"'")
    return t


def parse_pairs(text: str) -> tuple[dict, str]:
    """(annotations, rest) of a title in ``key=value;`` form; numbers, quoted strings, dicts, arrays and T/F are told apart."""
    found, at = {}, 0
    while m := _PAIR.match(text, at):
        found[m[1]] = _plain(m[2])
        at = m.end()
    return found, text[at:].strip()


@F.pandas_udf(T.StructType([T.StructField("notes", T.MapType(T.StringType(), T.StringType())), T.StructField("rest", T.StringType())]))
def _parsed(title: pd.Series) -> pd.DataFrame:
    rows = []
    for t in title:
        t = (t or "").strip()
        if t.startswith("{"):
            try:
                found, end = json.JSONDecoder().raw_decode(t)
                rest = t[end:].strip()
            except ValueError:
                found, rest = {}, t
        else:
            found, rest = parse_pairs(t)
        rows.append(({k: json.dumps(v, separators=(",", ":"), ensure_ascii=False) for k, v in found.items()}, rest))
    return pd.DataFrame(rows, columns=["notes", "rest"])


def with_title(df: DataFrame, title: str = "title") -> DataFrame:
    """Annotations and typed slots out of a title column; what is no annotation is the definition.

    ``count`` has to be a number. ``merged_<slot>`` go to ``merged``, ``taxid`` to its column, ``id`` and ``definition`` override.
    """
    out = df.withColumn("__t", _parsed(title))
    notes = F.col("__t.notes")
    text = lambda k: F.get_json_object(F.try_element_at(notes, F.lit(k)), "$")
    merged = F.transform_values(F.map_from_entries(F.transform(F.filter(F.map_entries(notes), lambda e: F.startswith(e["key"], F.lit("merged_"))), lambda e: F.struct(F.substr(e["key"], F.lit(8)).alias("key"), e["value"].alias("value")))), lambda _, v: F.from_json(v, "map<string,bigint>"))
    count = F.when(text("count").isNotNull() & text("count").try_cast("double").isNull(), F.raise_error(F.lit("count is no number")).cast("bigint")).otherwise(text("count").try_cast("double").cast("bigint"))
    own = {"id": F.coalesce(text("id"), F.col("id")), "definition": F.coalesce(text("definition"), F.when(F.col("__t.rest") != "", F.col("__t.rest"))), "count": F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)), "taxid": text("taxid"), "merged": merged}
    out = out.withColumns(own)
    taken = F.map_filter(notes, lambda k, _: ~(k.isin("id", "definition", "count", "taxid") | F.startswith(k, F.lit("merged_"))))
    return out.withColumn("annotations", taken).drop("__t", title)


def json_title(raw_taxid: bool = True) -> Column:
    """The record's annotations, count, taxid, definition and histograms as one JSON object."""
    entry = lambda k, v: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), v)
    notes = F.transform(F.map_entries("annotations"), lambda e: entry(e["key"], e["value"]))
    merged = F.transform(F.map_entries("merged"), lambda e: entry(F.concat(F.lit("merged_"), e["key"]), F.to_json(e["value"])))
    text = lambda c: F.substr(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    own = F.array_compact(F.array(entry(F.lit("count"), F.col("count").cast("string")), F.when(F.col("taxid").isNotNull(), entry(F.lit("taxid"), text("taxid"))), F.when(F.col("definition").isNotNull(), entry(F.lit("definition"), text("definition")))))
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.concat(own, notes, merged)), ","), F.lit("}"))


def pairs_title() -> Column:
    """The same as ``key=value;`` pairs and the definition."""
    notes = F.transform(F.map_entries("annotations"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.get_json_object(e["value"], "$"), e["value"]), F.lit(";")))
    own = F.array_compact(F.array(F.concat(F.lit("count="), F.col("count").cast("string"), F.lit(";")), F.when(F.col("taxid").isNotNull(), F.concat(F.lit("taxid="), "taxid", F.lit(";")))))
    merged = F.transform(F.map_entries("merged"), lambda e: F.concat(F.lit("merged_"), e["key"], F.lit("="), F.to_json(e["value"]), F.lit(";")))
    return F.concat_ws(" ", F.array_join(F.array_sort(F.concat(own, notes, merged)), " "), "definition")


COLUMNS = RECORD.names
