"""Low-complexity regions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.kernels.assembly import word_entropy
from strandloom.operators.patterns import flat_map


def kmer_entropy(max_word: int = 6):
    """Arrow UDF: the complexity of a k-mer, 0 to 1."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else word_entropy(x, max_word)).astype("float64")

    return run


def low_regions(s: str, k: int, max_word: int, threshold: float) -> list[tuple[int, int]]:
    """(start, end) of what windows of k letters with complexity of ``threshold`` or less cover."""
    out: list[list[int]] = []
    for i in range(len(s) - k + 1):
        if word_entropy(s[i : i + k], max_word, by_class_size=False) <= threshold:
            if out and i <= out[-1][1]:
                out[-1][1] = i + k
            else:
                out.append([i, i + k])
    return [(a, b) for a, b in out]


def mask_low(df: DataFrame, k: int = 31, max_word: int = 6, threshold: float = 0.5, letter: str = ".") -> DataFrame:
    """Regions of low complexity written as a letter."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            for a, b in low_regions(x, k, max_word, threshold):
                x = x[:a] + letter * (b - a) + x[b:]
            return x

        return s.map(lambda x: None if x is None else one(x))

    return df.withColumn("sequence", run("sequence"))


def extract_regions(df: DataFrame, low: bool = True, k: int = 31, max_word: int = 6, threshold: float = 0.5) -> DataFrame:
    """A record for each region of low, or of other, complexity."""

    def kernel(s: str) -> list[dict]:
        regions = low_regions(s, k, max_word, threshold)
        if not low:
            cuts = [0, *[x for r in regions for x in r], len(s)]
            regions = [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if b > a]
        return [{"start": a, "end": b} for a, b in regions]

    out = flat_map(df, kernel, "start int, end int")
    a, n = F.col("start") + 1, F.col("end") - F.col("start")
    return out.withColumns({"sequence": F.substr("sequence", a, n), "qualities": F.slice("qualities", a, n), "id": F.format_string("%s_sub[%d..%d]", "id", a, F.col("end"))}).select(*df.columns)
