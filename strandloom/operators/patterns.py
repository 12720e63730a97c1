"""Operators on approximate patterns: hits, in-silico PCR, splitting, microsatellites, demultiplexing.

The kernels read Arrow batches; what they produce stays next to its record, so none of these operators shuffles.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.sequences import revcomp, smallest_rotation_both
from strandloom.kernels.patterns import Pattern, best_match, best_matches, compile_pattern, find_all
from strandloom.records import set_attributes

_COMPLEMENT = str.maketrans("acgturyswkmbdhvn[]", "tgcaayrswmkvhdbn][")


def _rc(s: str) -> str:
    return s.translate(_COMPLEMENT)[::-1]


def any_hit(pattern: str, errors: int, indels: bool = False, both_strands: bool = True) -> Callable[[Column], Column]:
    """Arrow UDF: whether a sequence has a hit on either strand."""
    p = compile_pattern(pattern, errors, indels)
    strands = [p, p.reverse_complement()] if both_strands else [p]

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x is not None and any(find_all(q, x) for q in strands)).astype(bool)

    return run


def annotate_pattern(df: DataFrame, pattern: str, name: str = "pattern", errors: int = 0, indels: bool = False, both_strands: bool = True, where: Column | None = None) -> DataFrame:
    """``<name>_match``, ``_error`` and ``_location`` of the best hit; a hit on the forward strand wins over one on the reverse."""
    p = compile_pattern(pattern, errors, indels)
    back = p.reverse_complement()

    @F.pandas_udf("struct<m:string,e:int,l:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            hit = best_match(p, x) if x else None
            if hit:
                rows.append((x[hit[0] : hit[1]], hit[2], f"{hit[0] + 1}..{hit[1]}"))
                continue
            hit = best_match(back, x) if x and both_strands else None
            rows.append((_rc(x[hit[0] : hit[1]]), hit[2], f"complement({hit[0] + 1}..{hit[1]})") if hit else (None, None, None))
        return pd.DataFrame(rows, columns=["m", "e", "l"]).astype({"e": "Int32"})

    hit = df.withColumn("__hit", run("sequence"))
    keys = {f"{name}_pattern": F.when(F.col("__hit.m").isNotNull(), F.lit(pattern)), f"{name}_match": F.col("__hit.m"), f"{name}_error": F.col("__hit.e"), f"{name}_location": F.col("__hit.l")}
    return set_attributes(hit, keys, where).drop("__hit")


def flat_map(df: DataFrame, kernel: Callable[[str], list[dict]], made: str) -> DataFrame:
    """A row for each dict that the kernel makes of a sequence, beside its record's columns, in ``made``'s fields."""
    fields = T._parse_datatype_string(f"array<struct<{made}>>")
    names = fields.elementType.names

    @F.pandas_udf(fields)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{n: d.get(n) for n in names} for d in kernel(x)] if x else [])

    return df.withColumn("__made", F.explode(run("sequence"))).select(*df.columns, "__made.*")


def amplicons(s: str, forward: Pattern, reverse: Pattern, min_length: int = 0, max_length: int | None = None, circular: bool = False, flank: int | None = None, full_flanks: bool = False) -> list[dict]:
    """What two primers amplify in a sequence, on both strands. Touching primers amplify nothing. ``anchor`` is where the first primer begins; of the second one only hits within the allowed lengths are looked at."""
    found, n = [], len(s)
    text = s + s if circular else s
    for direction, first, second in (("forward", forward, reverse.reverse_complement()), ("reverse", reverse, forward.reverse_complement())):
        starts = [h for h in find_all(first, text) if h[0] < n]
        if not starts:
            continue
        ends = sorted(find_all(second, text))
        at = [b[0] for b in ends]
        for a in starts:
            longest = n if max_length is None else max_length
            for b in ends[bisect_left(at, a[1] + max(min_length, 1)) : bisect_right(at, a[1] + longest)]:
                if b[1] - a[0] > n:
                    continue
                left, right = (a[1], b[0]) if flank is None else (a[0] - flank, b[1] + flank)
                if full_flanks and (left < 0 or right > len(text)):
                    continue
                left, right = max(left, 0), min(right, len(text))
                piece, at_first, at_second = text[left:right], text[a[0] : a[1]], text[b[0] : b[1]]
                if direction == "forward":
                    f, r, hit_f, hit_r = at_first, _rc(at_second), a, b
                else:
                    piece, f, r, hit_f, hit_r = _rc(piece), _rc(at_second), at_first, b, a
                found.append({"amplicon": piece, "direction": direction, "forward_match": f, "reverse_match": r, "forward_error": hit_f[2], "reverse_error": hit_r[2], "start": left, "end": right, "anchor": a[0]})
    return found


def pcr(df: DataFrame, forward: str, reverse: str, errors: int = 0, min_length: int = 0, max_length: int | None = None, circular: bool = False, flank: int | None = None, full_flanks: bool = False, fragment: int | None = None) -> DataFrame:
    """In-silico PCR: one record per amplicon, which inherits the template's annotations.

    ``fragment``: templates longer than this are first cut into windows that overlap by the longest
    amplicon with its primers, and spread over tasks, so that one chromosome is not one task's work.
    """
    f, r = compile_pattern(forward, errors), compile_pattern(reverse, errors)
    work, own = df.withColumn("__offset", F.lit(0)), F.lit(True)
    if fragment is not None:
        if circular or max_length is None:
            raise ValueError("fragments need a maximal length and linear templates")
        overlap = max_length + len(f) + len(r) + 2 * (flank or 0)
        step = max(fragment, 2 * overlap)
        windows = F.sequence(F.lit(0), F.greatest(F.length("sequence") - overlap - 1, F.lit(0)), F.lit(step))
        work = df.select(*df.columns, F.explode(windows).alias("__offset"), F.length("sequence").alias("__length")).withColumn("sequence", F.substr("sequence", F.col("__offset") + 1, F.lit(step + overlap)))
        work = work.repartition("id", "__offset")
        # what stands in the overlap of two windows belongs to the one in which it has its flanks and begins first
        low, last = flank or 0, F.col("__offset") + step > F.col("__length") - overlap - 1
        own = ((F.col("__offset") == 0) | (F.col("anchor") >= low)) & ((F.col("anchor") < step + low) | last)
    made = "amplicon string, direction string, forward_match string, reverse_match string, forward_error int, reverse_error int, start int, end int, anchor int"
    out = flat_map(work, lambda s: amplicons(s, f, r, min_length, max_length, circular, flank, full_flanks), made).where(own)
    first, last = F.col("__offset") + F.col("start"), F.col("__offset") + F.col("end")
    out = out.withColumns({"__first": first, "__last": last})
    out = out.withColumns({"id": F.format_string("%s_sub[%d..%d]", "id", F.col("__first") + 1, F.col("__last")), "sequence": F.col("amplicon"), "qualities": F.lit(None).cast("array<tinyint>")})
    keys = {"forward_primer": F.lit(forward), "reverse_primer": F.lit(reverse), **{c: F.col(c) for c in ("direction", "forward_match", "reverse_match", "forward_error", "reverse_error")}}
    return set_attributes(out, keys).select(*df.columns)


def split_on_patterns(df: DataFrame, patterns: dict[str, str], errors: int = 4, indels: bool = False, group: str = "split") -> DataFrame:
    """Cut sequences at the hits of patterns (name -> pattern), on both strands: a record per piece between hits, with what stands at its ends."""
    compiled = [(name, p, compile_pattern(p, errors, indels)) for name, p in patterns.items()]

    def kernel(s: str) -> list[dict]:
        hits = []
        for name, text, p in compiled:
            hits += [(a, b, e, name, text, "forward") for a, b, e in best_matches(p, s)] + [(a, b, e, name, text, "reverse") for a, b, e in best_matches(p.reverse_complement(), s)]
        kept: list[tuple] = []
        for h in sorted(hits, key=lambda h: (h[2], h[0])):
            if all(h[1] <= k[0] or k[1] <= h[0] for k in kept):
                kept.append(h)
        kept.sort()
        bounds = [(0, 0, 0, "extremity", "", ""), *kept, (len(s), len(s), 0, "extremity", "", "")]
        pieces = [(x, y) for x, y in zip(bounds, bounds[1:]) if y[0] > x[1]]
        return [{"piece": s[x[1] : y[0]], "n": i + 1, "of": len(pieces), "start": x[1], "end": y[0], "left": x[3], "right": y[3], "left_pattern": x[4], "right_pattern": y[4], "left_match": s[x[0] : x[1]], "right_match": s[y[0] : y[1]], "left_error": x[2], "right_error": y[2]} for i, (x, y) in enumerate(pieces)]

    made = "piece string, n int, of int, start int, end int, left string, right string, left_pattern string, right_pattern string, left_match string, right_match string, left_error int, right_error int"
    out = flat_map(df, kernel, made)
    pair = F.concat_ws("-", F.array_sort(F.array("left", "right")))
    keys = {f"{group}_frg": F.col("n"), f"{group}_nfrg": F.col("of"), f"{group}_group": pair, f"{group}_set": F.concat_ws("-", "left", "right"), f"{group}_location": F.format_string("%d..%d", F.col("start") + 1, F.col("end")), f"{group}_left_error": F.col("left_error"), f"{group}_right_error": F.col("right_error"), f"{group}_left_match": F.col("left_match"), f"{group}_right_match": F.col("right_match"), f"{group}_left_pattern": F.col("left_pattern"), f"{group}_right_pattern": F.col("right_pattern")}
    a, n = F.col("start") + 1, F.col("end") - F.col("start")
    out = out.withColumns({"sequence": F.col("piece"), "qualities": F.slice("qualities", a, n), "id": F.format_string("%s_sub[%d..%d]", "id", a, F.col("end"))})
    return set_attributes(out, keys).select(*df.columns)


def microsatellites(df: DataFrame, min_unit: int = 1, max_unit: int = 6, min_count: int = 5, min_flank: int = 0, reorient: bool = False) -> DataFrame:
    """Records with a repeated unit, annotated; the others go. Built-in expressions: a regular expression with a back reference, then the unit's own repeat."""
    regex = f"([acgt]{{{min_unit},{max_unit}}}?)\\1{{{min_count - 1},}}"
    out = df.withColumn("__m", F.regexp_extract("sequence", f"({regex.replace(chr(92) + '1', chr(92) + '2')})", 1)).where(F.length("__m") > 0)
    out = out.withColumn("__unit", F.regexp_extract("__m", r"^([acgt]+?)\1*$", 1))
    out = out.withColumn("__start", F.instr("sequence", F.col("__m")))
    out = out.withColumn("__end", F.col("__start") + F.length("__m") - 1)
    out = out.where((F.col("__start") - 1 >= min_flank) & (F.length("sequence") - F.col("__end") >= min_flank)).withColumn("__normal", smallest_rotation_both("__unit"))
    from strandloom.functions.sequences import smallest_rotation

    direct = smallest_rotation("__unit") == F.col("__normal")
    keys = {"microsat_unit_length": F.length("__unit"), "microsat_unit_count": (F.length("__m") / F.length("__unit")).cast("int"), "seq_length": F.length("sequence"), "microsat": F.col("__m"), "microsat_from": F.col("__start"), "microsat_to": F.col("__end"), "microsat_unit": F.col("__unit"), "microsat_unit_normalized": F.col("__normal"), "microsat_unit_orientation": F.when(direct, "direct").otherwise("reverse"), "microsat_left": F.substr("sequence", F.lit(1), F.col("__start") - 1), "microsat_right": F.substr("sequence", F.col("__end") + 1)}
    out = set_attributes(out, keys)
    if reorient:
        turn = ~direct
        out = out.withColumns({"sequence": F.when(turn, revcomp("sequence")).otherwise(F.col("sequence")), "qualities": F.when(turn, F.reverse("qualities")).otherwise(F.col("qualities")), "id": F.when(turn, F.concat("id", F.lit("_cmp"))).otherwise(F.col("id"))})
    return out.select(*df.columns)


def batches_of(df: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Apply a function of pandas batches; for kernels that need several columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield kernel(f)

    return df.mapInPandas(run, schema)
