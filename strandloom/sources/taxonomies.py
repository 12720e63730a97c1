"""Taxonomies from dumps and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.taxonomy import clean_taxid, from_records
from strandloom.sources.readers import read_sequences


def _dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.transform(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t"), lambda x: F.trim(x)).alias("c"))


def read_taxdump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(taxa, aliases) of nodes.dmp, names.dmp and merged.dmp; names of other classes than the scientific one are in ``alt_names``."""
    cell = lambda i: F.element_at("c", i)
    nodes = _dump(spark, f"{folder}/nodes.dmp").select(cell(1).alias("taxid"), cell(2).alias("parent"), cell(3).alias("rank"))
    names = _dump(spark, f"{folder}/names.dmp").select(cell(1).alias("taxid"), cell(2).alias("name"), cell(4).alias("class"))
    scientific = names.where("class = 'scientific name'").groupBy("taxid").agg(F.min("name").alias("scientific_name"))
    other = names.where("class <> 'scientific name'").groupBy("taxid", "name").agg(F.min("class").alias("class")).groupBy("taxid").agg(F.map_from_entries(F.collect_list(F.struct("name", "class"))).alias("m"))
    alternative = other.select("taxid", F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(F.concat(e["value"], F.lit(": "), e["key"]).alias("key"), e["key"].alias("value")))).alias("alt_names"))
    taxa = nodes.join(scientific, "taxid", "left").join(alternative, "taxid", "left")
    aliases = _dump(spark, f"{folder}/merged.dmp").select(cell(1).alias("old_taxid"), cell(2).alias("taxid"))
    return taxa, aliases


def read_taxonomy_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns taxid, parent, scientific_name, taxonomic_rank; ids plain or as ``code:taxid [name]@rank``."""
    rows = spark.read.options(header="true").csv(path)
    return rows.select(clean_taxid(F.col("taxid")).alias("taxid"), clean_taxid(F.coalesce("parent", "taxid")).alias("parent"), F.col("taxonomic_rank").alias("rank"), "scientific_name")


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """A folder is a dump; a file is a table, or sequences whose paths make a taxonomy."""
    if path.endswith((".csv", ".csv.gz")):
        return read_taxonomy_csv(spark, path), None
    if path.rstrip("/").rsplit("/", 1)[-1].split(".")[-1] in ("fasta", "fastq", "fa", "fq", "gz"):
        return from_records(read_sequences(spark, path)), None
    return read_taxdump(spark, path)
