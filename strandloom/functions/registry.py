"""Functions for ``spark.sql``: SQL functions where an expression does, Arrow UDFs for kernels, UDTFs for rows out of a value."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.kernels.distance import lcs_distance, one_difference
from strandloom.kernels.patterns import compile_pattern, find_all

# The complement of each letter, as text for translate().
_RC = f"reverse(translate(regexp_replace(lower(s), '[^acgturyswkmbdhvn.\\\\-\\\\[\\\\]]', 'n'), '{S.LETTERS}', '{S.COMPLEMENTS}'))"
EXPRESSIONS = {
    "revcomp(s STRING) RETURNS STRING": _RC,
    "gc(s STRING) RETURNS DOUBLE": "try_divide(CAST(length(s) - length(translate(lower(s), 'gc', '')) AS DOUBLE), CAST(length(s) - length(translate(lower(s), 'acgt', '')) AS DOUBLE))",
    "gcskew(s STRING) RETURNS DOUBLE": "try_divide(CAST(length(translate(lower(s), 'c', '')) - length(translate(lower(s), 'g', '')) AS DOUBLE), CAST(length(s) - length(translate(lower(s), 'gc', '')) AS DOUBLE))",
    "canonical(k STRING) RETURNS STRING": "least(k, reverse(translate(k, 'acgt', 'tgca')))",
    "encode_kmer(k STRING) RETURNS BIGINT": "CAST(conv(translate(k, 'acgtu', '01233'), 4, 10) AS BIGINT)",
    "kmers(s STRING, k INT) RETURNS ARRAY<STRING>": "IF(length(s) >= k, transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)), CAST(array() AS ARRAY<STRING>))",
}


def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else (lambda f: f[1] - f[0])(lcs_distance(x, y)) for x, y in zip(a, b)], dtype="Int32")


def _d1(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else one_difference(x, y)[0] for x, y in zip(a, b)], dtype="Int32")


def _match(s: pd.Series, pattern: pd.Series, errors: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else bool(find_all(compile_pattern(p, int(e)), x)) for x, p, e in zip(s, pattern, errors)], dtype="boolean")


class _FindPattern:
    def eval(self, s: str, pattern: str, errors: int):
        for a, b, e in find_all(compile_pattern(pattern, errors), s or ""):
            yield a + 1, b, e


def register(spark: SparkSession) -> None:
    """Make all functions known to a session."""
    for signature, body in EXPRESSIONS.items():
        name, _, returns = signature.partition(" RETURNS ")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {returns} RETURN {body}")
    spark.udf.register("lcs_distance", F.pandas_udf(_lcs, "int"))
    spark.udf.register("one_difference", F.pandas_udf(_d1, "int"))
    spark.udf.register("iupac_match", F.pandas_udf(_match, "boolean"))
    spark.udtf.register("find_pattern", F.udtf(_FindPattern, returnType="start: int, end: int, errors: int"))


def apply_record(df: DataFrame, fn: Callable[[dict], dict | list[dict] | None], schema=None) -> DataFrame:
    """A Python function of one record: it returns a record, several, or None to drop it."""
    schema = schema or df.schema
    names = [f.name for f in schema.fields]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            out = []
            for row in b.to_pylist():
                made = fn({k: dict(v) if isinstance(v, list) and v and isinstance(v[0], tuple) else v for k, v in row.items()})
                out += [] if made is None else made if isinstance(made, list) else [made]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema=arrow)

    return df.mapInArrow(run, schema)


def apply_batch(df: DataFrame, fn: Callable, schema=None) -> DataFrame:
    """A function of Arrow batches; counters are Spark accumulators that ``fn`` closes over."""

    def run(batches):
        for b in batches:
            yield fn(b)

    return df.mapInArrow(run, schema or df.schema)
