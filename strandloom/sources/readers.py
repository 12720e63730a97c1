"""Readers: each gives records of RECORD columns. Scans are Spark's own and split large files; nothing is opened outside them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.records import as_records
from strandloom.sources.titles import with_title

Paths = str | list[str]
SUFFIXES = "*.{fasta,fa,fastq,fq,seq,gb,gbff,dat,embl,ecopcr}{,.gz}"


def _text(spark: SparkSession, paths: Paths, separator: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if separator is not None:
        reader = reader.option("lineSep", separator)
    return reader.text(paths).withColumn("source", F.regexp_replace(F.col("_metadata.file_name"), r"\..*$", ""))


def _finish(df: DataFrame, u_to_t: bool) -> DataFrame:
    out = as_records(df.withColumn("input_order", F.monotonically_increasing_id()))
    return out.withColumn("sequence", F.translate("sequence", "u", "t")) if u_to_t else out


def read_fasta(spark: SparkSession, paths: Paths, u_to_t: bool = False) -> DataFrame:
    """Sequences over any number of lines; the title is the id and annotations or a definition."""
    rows = _text(spark, paths, "\n>").withColumn("value", F.regexp_replace("value", "^>|\r", "")).where(F.trim("value") != "")
    title = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.substr("value", F.instr("value", F.lit("\n")) + 1)).otherwise("")
    out = rows.select("source", F.regexp_extract(title, r"^\s*(\S*)", 1).alias("id"), F.regexp_extract(title, r"^\s*\S*\s*(.*)$", 1).alias("title"), F.regexp_replace(body, r"\s", "").alias("sequence"))
    return _finish(with_title(out), u_to_t)


def read_fastq(spark: SparkSession, paths: Paths, shift: int = 33, with_qualities: bool = True, u_to_t: bool = False) -> DataFrame:
    """Records of four lines.

    Text is split at line ends before an ``@``; where that was the first sign of a quality line the two
    parts are put together again: inside a block of the file in passing, across blocks by a join of what
    one block lacks at its end with what the next has too much at its start.
    """
    raw = _text(spark, paths, "\n@").select("source", F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length")).alias("end"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, place = None, None
        for f in frames:
            out = []
            for source, value, file, begin, end in f.itertuples(index=False, name=None):
                if (file, begin) != place:
                    if before is not None:
                        out.append((*before, "tail"))
                    before, place = None, (file, begin)
                    value = value.removeprefix("@") if begin == 0 else value
                lines = value.replace("\r", "").rstrip("\n").split("\n")
                if before is not None:
                    out.append((before[0], f"{before[1]}\n@{value}", file, begin, end, "whole"))
                    before = None
                elif len(lines) == 1 and begin > 0:
                    out.append((source, value, file, begin, end, "head"))
                elif len(lines) == 3 and lines[2].startswith("+"):
                    before = (source, value, file, begin, end)
                elif any(lines):
                    out.append((source, value, file, begin, end, "whole"))
            yield pd.DataFrame(out, columns=["source", "value", "file", "begin", "end", "part"])
        if before is not None:
            yield pd.DataFrame([(*before, "tail")], columns=["source", "value", "file", "begin", "end", "part"])

    parts = raw.mapInPandas(run, "source string, value string, file string, begin long, end long, part string")
    heads = parts.where("part = 'head'").select("file", F.col("begin").alias("end"), F.col("value").alias("rest"))
    mended = parts.where("part = 'tail'").join(heads, ["file", "end"], "left").select("source", F.concat("value", F.lit("\n@"), F.coalesce("rest", F.lit(""))).alias("value"))
    rows = parts.where("part = 'whole'").select("source", "value").union(mended)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    q = F.element_at(lines, 4)
    fits = F.assert_true(F.length(F.element_at(lines, 2)) == F.length(q), F.lit("a FASTQ record has fewer or more qualities than bases"))
    qualities = F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: (F.ascii(c) - shift).cast("tinyint")) if with_qualities else F.lit(None)
    title = F.element_at(lines, 1)
    out = rows.select("source", F.regexp_extract(title, r"^(\S*)", 1).alias("id"), F.regexp_extract(title, r"^\S*\s*(.*)$", 1).alias("title"), F.coalesce(fits.cast("string"), F.element_at(lines, 2)).alias("sequence"), qualities.alias("qualities"))
    return _finish(with_title(out), u_to_t)


def _flat(spark: SparkSession, paths: Paths) -> DataFrame:
    return _text(spark, paths, "\n//").withColumn("value", F.regexp_replace("value", r"\r|^\s*\n", "")).where(F.trim("value") != "")


def _joined(value: Column | str, line: str) -> Column:
    """Texts of all lines of a two-letter kind."""
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(rf"(?m)^{line}   (.*)$"), F.lit(1)), lambda x: F.trim(x)), " ")


def read_embl(spark: SparkSession, paths: Paths, with_features: bool = False, u_to_t: bool = False) -> DataFrame:
    """Flat files of entries that end in ``//``; the taxid is that of the source feature, 1 without one."""
    rows = _flat(spark, paths)
    taxid = F.regexp_extract("value", r'/db_xref="taxon:(\d+)', 1)
    body = F.regexp_extract("value", r"(?s)\nSQ   [^\n]*\n(.*)$", 1)
    notes = F.map_from_entries(F.array(F.struct(F.lit("scientific_name").alias("key"), F.to_json(F.array(_joined("value", "OS"))).alias("value"))))
    out = rows.select(
        "source", F.regexp_extract("value", r"(?m)^ID   ([^;\s]+)", 1).alias("id"), F.regexp_replace(body, r"[^A-Za-z]", "").alias("sequence"), F.nullif(_joined("value", "DE"), F.lit("")).alias("definition"),
        F.when(taxid == "", "1").otherwise(taxid).alias("taxid"), F.transform_values(notes, lambda _, v: F.substr(v, F.lit(2), F.length(v) - 2)).alias("annotations"), *([_joined("value", "FT").alias("features")] if with_features else []),
    )
    return _finish(out, u_to_t)


def read_genbank(spark: SparkSession, paths: Paths, with_features: bool = False, u_to_t: bool = False) -> DataFrame:
    rows = _flat(spark, paths)
    taxid = F.regexp_extract("value", r'/db_xref="taxon:(\d+)', 1)
    body = F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    definition = F.regexp_replace(F.regexp_extract("value", r"(?s)\nDEFINITION  (.*?)\n(?=\S)", 1), r"\s*\n\s+", " ")
    name = F.regexp_extract("value", r"\nSOURCE      ([^\n]*)", 1)
    notes = F.create_map(F.lit("scientific_name"), F.substr(F.to_json(F.array(name)), F.lit(2), F.length(F.to_json(F.array(name))) - 2))
    out = rows.select(
        "source", F.regexp_extract("value", r"(?m)^LOCUS\s+(\S+)", 1).alias("id"), F.regexp_replace(body, r"[^A-Za-z]", "").alias("sequence"), F.nullif(definition, F.lit("")).alias("definition"),
        F.when(taxid == "", "1").otherwise(taxid).alias("taxid"), notes.alias("annotations"), *([F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*\n(.*?)\nORIGIN", 1).alias("features")] if with_features else []),
    )
    return _finish(out, u_to_t)


def read_csv(spark: SparkSession, paths: Paths, separator: str = ",", u_to_t: bool = False) -> DataFrame:
    """A header row; ``id``, ``sequence``, ``qualities``, ``count``, ``taxid`` and ``definition`` are the record's, other columns annotations, JSON if they parse as such."""
    rows = spark.read.options(header="true", comment="#", sep=separator, ignoreLeadingWhiteSpace="true", quote='"', escape='"', multiLine="false").csv(paths)
    own = [c for c in ("id", "sequence", "definition", "taxid") if c in rows.columns]
    others = [c for c in rows.columns if c not in (*own, "qualities", "count")]

    def as_json(c: str) -> Column:
        text = F.to_json(F.array(F.col(f"`{c}`")))
        quoted = F.substr(text, F.lit(2), F.length(text) - 2)
        return F.when(F.try_parse_json(F.col(f"`{c}`")).isNotNull(), F.col(f"`{c}`")).otherwise(quoted)

    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.when(F.col(f"`{c}`").isNotNull(), as_json(c)).alias("value")) for c in others]), lambda e: e["value"].isNotNull()) if others else None
    out = rows.select(*own, *([F.transform(F.filter(F.split("qualities", ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33).cast("tinyint")).alias("qualities")] if "qualities" in rows.columns else []), *([F.col("count").try_cast("bigint").alias("count")] if "count" in rows.columns else []), *([F.map_from_entries(entries).alias("annotations")] if entries is not None else []), F.regexp_replace(F.col("_metadata.file_name"), r"\..*$", "").alias("source"))
    return _finish(out, u_to_t)


ECOPCR = ["ac", "seq_length", "taxid", "rank", "species_taxid", "species_name", "genus_taxid", "genus_name", "family_taxid", "family_name", "superkingdom_taxid", "superkingdom_name", "strand", "forward_match", "forward_error", "forward_tm", "reverse_match", "reverse_error", "reverse_tm", "amplicon_length", "sequence", "definition"]


def read_ecopcr(spark: SparkSession, paths: Paths) -> DataFrame:
    """Columns parted by bars, 20 without melting temperatures or 22; an accession's further amplicons get ``_2``, ``_3``, ..."""
    rows = _text(spark, paths).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    cells = F.transform(F.split("value", r"\s*\|\s*"), lambda x: F.trim(x))
    short = [c for c in ECOPCR if not c.endswith("_tm")]
    pick = lambda c: F.when(F.size(cells) >= 22, F.try_element_at(cells, F.lit(ECOPCR.index(c) + 1))).otherwise(F.try_element_at(cells, F.lit(short.index(c) + 1)) if c in short else F.lit(None))
    out = rows.select("source", F.monotonically_increasing_id().alias("input_order"), *[pick(c).alias(c) for c in ECOPCR])
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("ac").orderBy("input_order"))
    out = out.withColumn("__n", n).withColumn("id", F.when(F.col("__n") == 1, F.col("ac")).otherwise(F.concat("ac", F.lit("_"), F.col("__n").cast("string"))))
    notes = [c for c in ECOPCR if c not in ("sequence", "definition", "taxid")]
    number = lambda c: F.when(F.col(c).rlike(r"^-?\d+(\.\d+)?$"), F.col(c)).otherwise(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.when(F.col(c).isNotNull() & (F.col(c) != ""), number(c)).alias("value")) for c in notes]), lambda e: e["value"].isNotNull())
    return as_records(out.select("id", "sequence", "definition", "taxid", "source", "input_order", F.map_from_entries(entries).alias("annotations")))


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a file by its first lines: fasta, fastq, embl, genbank, ecopcr, csv or empty."""
    first = [r["value"] for r in spark.read.option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "").limit(1).collect()]
    if not first:
        return "empty"
    line = first[0].lstrip("﻿")
    for begin, kind in ((">", "fasta"), ("@", "fastq"), ("ID   ", "embl"), ("LOCUS ", "genbank"), ("#@ecopcr", "ecopcr"), ("# ecoPCR", "ecopcr")):
        if line.startswith(begin):
            return kind
    return "csv" if "," in line else "ecopcr" if line.count("|") > 10 else "csv"


def read_sequences(spark: SparkSession, path: str, form: str = "guess", **options) -> DataFrame:
    """Records of a file or folder; an empty file has none."""
    form = sniff(spark, path) if form == "guess" else form
    readers = {"fasta": read_fasta, "fastq": read_fastq, "embl": read_embl, "genbank": read_genbank, "csv": read_csv, "ecopcr": read_ecopcr}
    if form == "empty":
        return as_records(spark.createDataFrame([], "id string, sequence string"))
    if form not in readers:
        raise ValueError(f"unknown format {form!r}")
    return readers[form](spark, path, **options)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where(F.col("id") != "")
