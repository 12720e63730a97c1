"""Writers. Rows are written where they are; sort by ``input_order`` first where order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.annotate import quality_text
from strandloom.records import attribute
from strandloom.sources.titles import json_title, pairs_title


def _checked_id() -> Column:
    return F.when(F.coalesce(F.length("id"), F.lit(0)) == 0, F.raise_error(F.lit("a record without an id can't be written")).cast("string")).otherwise(F.col("id"))


def _title(style: str) -> Column:
    return json_title() if style == "json" else pairs_title()


def fasta_text(style: str = "json", width: int = 60) -> Column:
    folded = F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return F.concat(F.lit(">"), _checked_id(), F.lit(" "), _title(style), F.lit("\n"), folded)


def fastq_text(style: str = "json", shift: int = 33) -> Column:
    return F.concat(F.lit("@"), _checked_id(), F.lit(" "), _title(style), F.lit("\n"), "sequence", F.lit("\n+\n"), quality_text(shift))


def write_fasta(df: DataFrame, path: str, style: str = "json", compression: str = "none", mode: str = "errorifexists") -> None:
    df.select(fasta_text(style).alias("value")).write.mode(mode).option("compression", compression).text(path)


def write_fastq(df: DataFrame, path: str, style: str = "json", compression: str = "none", mode: str = "errorifexists") -> None:
    df.select(fastq_text(style).alias("value")).write.mode(mode).option("compression", compression).text(path)


def write_sequences(df: DataFrame, path: str, **options) -> None:
    """FASTQ if the first record has qualities, else FASTA."""
    first = df.select("qualities").limit(1).collect()
    (write_fastq if first and first[0]["qualities"] is not None else write_fasta)(df, path, **options)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    notes = F.from_json(json_title(), "map<string,string>")
    df.select("id", "sequence", F.when(F.col("qualities").isNotNull(), quality_text()).alias("qualities"), notes.alias("annotations")).write.mode(mode).json(path)


def scalar_keys(df: DataFrame, limit: int = 10_000) -> list[str]:
    """Keys of scalar annotations over all records, sorted; more than ``limit`` are an error, as each becomes a column."""
    rows = df.select(F.explode("annotations").alias("k", "v")).where(~F.substr("v", F.lit(1), F.lit(1)).isin("{", "[")).select("k").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"records have more than {limit} keys: name those to write")
    return sorted(r["k"] for r in rows)


def table(df: DataFrame, keys: list[str] | None = None, ids: bool = True, count: bool = False, taxon: bool = False, definition: bool = False, sequence: bool = False, qualities: bool = False, na: str = "NA") -> DataFrame:
    """Records as a table; ``keys`` None takes all scalar ones."""
    keys = scalar_keys(df) if keys is None else keys
    own = [*(["id"] if ids else []), *(["count"] if count else []), *(["taxid"] if taxon else []), *(["definition"] if definition else [])]
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(na)).alias(c) for c in own], *[F.coalesce(attribute(k), F.lit(na)).alias(k) for k in keys], *(["sequence"] if sequence else []), *([quality_text().alias("qualities")] if qualities else []))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", **columns) -> None:
    table(df, **columns).write.mode(mode).options(header="true", escape='"').csv(path)


def taxa_table(taxa: DataFrame, with_path: bool = False) -> DataFrame:
    path = [F.array_join(F.transform("path", lambda x: F.concat(x["taxid"], F.lit("@"), x["name"], F.lit("@"), x["rank"])), "|").alias("path")] if with_path else []
    return taxa.select("taxid", "parent", F.col("rank").alias("taxonomic_rank"), "scientific_name", *path)


def write_pairs(pairs: DataFrame, path: str, fastq: bool = True, **options) -> None:
    """``<path>_R1`` and ``<path>_R2``."""
    write = write_fastq if fastq else write_fasta
    write(pairs.drop("mate"), f"{path}_R1", **options)
    mates = pairs.withColumns({c: F.col(f"mate.{c}") for c in ("id", "sequence", "qualities", "annotations")}).drop("mate")
    write(mates, f"{path}_R2", **options)


def gml(nodes: DataFrame, edges: DataFrame, sample: str, max_nodes: int = 100_000) -> str:
    """The error graph of one sample as GML text, for a viewer; bounded."""
    n = nodes.where(F.col("sample") == sample).select("id", "n").orderBy("id").limit(max_nodes + 1).collect()
    if len(n) > max_nodes:
        raise ValueError(f"a graph of more than {max_nodes} nodes")
    at = {r["id"]: i for i, r in enumerate(n)}
    e = edges.where(F.col("sample") == sample).select("son", "father", "dist").orderBy("son", "father").limit(10 * max_nodes + 1).collect()
    if len(e) > 10 * max_nodes:
        raise ValueError(f"a graph of more than {10 * max_nodes} edges")
    body = "".join(f'node [ id {i} label "{r["id"]}" weight {r["n"]} ]\n' for i, r in enumerate(n))
    body += "".join(f"edge [ source {at[r['son']]} target {at[r['father']]} dist {r['dist']} ]\n" for r in e)
    return f"graph [\ndirected 1\n{body}]\n"
