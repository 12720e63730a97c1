"""k-mer sets: counts, spectra, set algebra, similarity, matching.

A set group is a table (set_id, kmer) of distinct canonical k-mers (text, or two-bit codes up to 31
bases), best written with ``write_index``: partitioned by set_id and sorted, so that Parquet prunes. All
operators hash-partition after the explode and combine on the map side.
"""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators.patterns import flat_map

_FLIP = str.maketrans("acgt", "tgca")


def explode_kmers(df: DataFrame, k: int, *keep: str) -> DataFrame:
    """(keep..., kmer): the canonical k-mers of each record, repeats included."""
    clean = F.regexp_replace(F.translate(F.lower("sequence"), "u", "t"), "[^acgt]", "a")
    return df.select(*keep, F.explode(S.kmers(clean, k)).alias("__k")).withColumn("kmer", S.canonical("__k")).drop("__k")


def count_kmers(df: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(by..., kmer, n)."""
    by = by or []
    return explode_kmers(df, k, *by).groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))


def build_index(df: DataFrame, k: int, set_id: str | Column = "set", min_count: int = 1, max_count: int | None = None, min_entropy: float | None = None, entropy_size: int = 6) -> DataFrame:
    """(set_id, kmer, n) with min_count <= n <= max_count, of complexity above ``min_entropy``."""
    sets = df.withColumn("set_id", F.lit(set_id) if isinstance(set_id, str) else set_id)
    out = count_kmers(sets, k, ["set_id"]).where(F.col("n") >= min_count)
    if max_count is not None:
        out = out.where(F.col("n") <= max_count)
    if min_entropy is not None:
        from strandloom.operators.complexity import kmer_entropy

        out = out.where(kmer_entropy(entropy_size)(F.col("kmer")) > min_entropy)
    return out


def write_index(index: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by set_id, k-mers range-sorted in each file."""
    index.repartitionByRange("set_id", "kmer").sortWithinPartitions("set_id", "kmer").write.partitionBy("set_id").mode(mode).parquet(path)


def copy_sets(index: DataFrame, pattern: str) -> DataFrame:
    """The sets whose id matches a glob."""
    like = pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    return index.where(F.col("set_id").cast("string").like(like))


def drop_sets(index: DataFrame, pattern: str) -> DataFrame:
    like = pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    return index.where(~F.col("set_id").cast("string").like(like))


def spectrum(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, kmers): how many k-mers occur n times."""
    return counts.groupBy(*(by or []), "n").agg(F.count(F.lit(1)).alias("kmers"))


def top_kmers(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), "kmer").limit(n)


def _sets_per_kmer(index: DataFrame) -> DataFrame:
    return index.select("set_id", "kmer").distinct().groupBy("kmer").agg(F.count(F.lit(1)).alias("sets"))


def union(index: DataFrame) -> DataFrame:
    return index.select("kmer").distinct()


def intersect(index: DataFrame, n_sets: int | None = None) -> DataFrame:
    """k-mers of all sets; ``n_sets`` spares a pass over the set ids."""
    n = n_sets if n_sets is not None else index.select("set_id").distinct().count()
    return _sets_per_kmer(index).where(F.col("sets") == n).select("kmer")


def difference(index: DataFrame, first: str) -> DataFrame:
    """k-mers of one set that no other has."""
    own = F.bool_or(F.col("set_id") == first)
    return index.groupBy("kmer").agg(own.alias("own"), F.bool_or(F.col("set_id") != first).alias("other")).where("own and not other").select("kmer")


def quorum(index: DataFrame, at_least: int | None = None, exactly: int | None = None, at_most: int | None = None) -> DataFrame:
    p = F.lit(True)
    for bound, test in ((at_least, F.col("sets").__ge__), (exactly, F.col("sets").__eq__), (at_most, F.col("sets").__le__)):
        if bound is not None:
            p = p & test(bound)
    return _sets_per_kmer(index).where(p).select("kmer")


def union_with(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("set_id", "kmer").union(b.select("set_id", "kmer")).distinct()


def intersect_with(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("set_id", "kmer").intersect(b.select("set_id", "kmer"))


def jaccard(index: DataFrame) -> DataFrame:
    """(set_i, set_j, shared, jaccard) for sets that share a k-mer, i < j. Sets per k-mer are few, so pairs come from each k-mer's own sets."""
    sets = index.select("set_id", "kmer").distinct()
    sizes = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    own = sets.groupBy("kmer").agg(F.array_sort(F.collect_list("set_id")).alias("s")).where(F.size("s") > 1).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    pairs = own.select("n", "s", F.posexplode("s").alias("i", "set_i")).select("n", "set_i", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("set_j"))
    shared = pairs.groupBy("set_i", "set_j").agg(F.sum("n").alias("shared"))
    out = shared.join(sizes.select(F.col("set_id").alias("set_i"), F.col("size").alias("a")), "set_i").join(sizes.select(F.col("set_id").alias("set_j"), F.col("size").alias("b")), "set_j")
    return out.select("set_i", "set_j", "shared", (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("jaccard"))


def contains(index: DataFrame, kmers: DataFrame) -> DataFrame:
    """Rows of the index whose k-mer is asked for."""
    return index.join(kmers.select("kmer").distinct(), "kmer", "left_semi")


def match_positions(df: DataFrame, index: DataFrame, k: int, key: str = "id") -> DataFrame:
    """(key, set_id, positions): 1-based places of a record's k-mers that a set has. Distinct k-mers meet the index, and a hot one is split by the optimizer."""
    places = df.select(key, F.posexplode(S.canonical_kmers("sequence", k)).alias("p", "kmer"))
    hits = places.join(index.select("set_id", "kmer").distinct(), "kmer")
    return hits.groupBy(key, "set_id").agg(F.array_sort(F.collect_list(F.col("p") + 1)).alias("positions"))


def shared_counts(queries: DataFrame, references: DataFrame, k: int, min_shared: int = 1, max_occurrences: int | None = None, sparse: bool = False, self_join: bool = False) -> DataFrame:
    """(query, reference, shared): pairs with at least ``min_shared`` distinct k-mers in common.

    ``max_occurrences`` leaves out reference k-mers of more records; ``sparse`` ignores the middle base
    of a k-mer of odd length. Every pair is counted from k-mers, none by comparing all with all.
    """
    if sparse and k % 2 == 0:
        raise ValueError("a sparse k-mer has an odd length")

    def own(df: DataFrame, name: str) -> DataFrame:
        kmer = F.col("kmer")
        if sparse:
            half = k // 2
            kmer = S.canonical(F.concat(F.substr("kmer", F.lit(1), F.lit(half)), F.substr("kmer", F.lit(half + 2))))
        return explode_kmers(df, k, F.col("id").alias(name)).select(name, kmer.alias("kmer")).distinct()

    r = own(references, "reference")
    if max_occurrences is not None:
        few = r.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_occurrences).select("kmer")
        r = r.join(few, "kmer", "left_semi")
    pairs = own(queries, "query").join(r, "kmer")
    if self_join:
        pairs = pairs.where("query < reference")
    return pairs.groupBy("query", "reference").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)


def superkmers(df: DataFrame, k: int, m: int) -> DataFrame:
    """Maximal runs of k-mers with one minimizer: (parent_id, id, sequence, minimizer_value, minimizer_seq, k, m, start, end).

    Minimizers are canonical m-mers, the smallest code of a k-mer's m-mers. Runs come from an Arrow kernel
    beside the record, so there is no shuffle.
    """
    w = k - m + 1

    def kernel(s: str) -> list[dict]:
        if len(s) < k:
            return []
        plain = re.sub("[^acgt]", "a", s.replace("u", "t"))
        flipped = plain.translate(_FLIP)[::-1]
        n = len(s)
        words = [min(plain[i : i + m], flipped[n - m - i : n - i]) for i in range(n - m + 1)]
        out, waiting, start, current = [], deque(), 0, None
        for i, word in enumerate(words):  # the smallest of w words in a row, from a queue of falling candidates
            while waiting and words[waiting[-1]] >= word:
                waiting.pop()
            waiting.append(i)
            if waiting[0] <= i - w:
                waiting.popleft()
            first = i - w + 1
            if first < 0:
                continue
            low = words[waiting[0]]
            if current is not None and low != current:
                out.append({"minimizer_seq": current, "start": start, "end": first + k - 1})
                start = first
            current = low
        out.append({"minimizer_seq": current, "start": start, "end": n})
        return out

    made = flat_map(df.select("id", "sequence"), kernel, "minimizer_seq string, start int, end int")
    return made.select(
        F.col("id").alias("parent_id"), F.format_string("%s_superkmer_%d_%d", "id", "start", "end").alias("id"), F.substr("sequence", F.col("start") + 1, F.col("end") - F.col("start")).alias("sequence"),
        S.encode_kmer("minimizer_seq").alias("minimizer_value"), "minimizer_seq", F.lit(k).alias("k"), F.lit(m).alias("m"), "start", "end",
    )


def fourmer_profile(s: str | Column = "sequence") -> Column:
    """Map of the 4-mers of a sequence to their numbers; ambiguous letters count as a."""
    words = S.kmers(F.regexp_replace(F.translate(F.lower(s), "u", "t"), "[^acgt]", "a"), 4)
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("key"), F.size(F.filter(words, lambda x: x == w)).alias("value"))))


def shared_fourmers(a: str, b: str) -> Column:
    """Sum of the smaller numbers over the 4-mers of two profiles."""
    return F.aggregate(F.map_keys(a), F.lit(0), lambda s, w: s + F.least(F.element_at(F.col(a), w), F.coalesce(F.try_element_at(F.col(b), w), F.lit(0))))
