"""Operators on sequencing reads: assembly of pairs, demultiplexing by tags, tagging of both mates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import hamming, revcomp
from strandloom.kernels.assembly import assemble
from strandloom.kernels.patterns import compile_pattern, find_all
from strandloom.operators.patterns import _rc, flat_map
from strandloom.records import set_attributes

_ASSEMBLY = "mode string, sequence string, qualities array<tinyint>, score int, score_norm double, ali_length int, ali_dir string, seq_a_single int, seq_b_single int, seq_ab_match int, pairing_fast_count int, pairing_fast_overlap int, pairing_fast_score double, pairing_mismatches map<string,int>"


def assemble_pairs(pairs: DataFrame, min_overlap: int = 20, min_identity: float = 0.9, delta: int = 5, gap: float = 2.0, fast: bool = True, with_stats: bool = True) -> DataFrame:
    """One record per pair of (record, ``mate`` struct): the consensus if they overlap well, else both joined; ``mode`` tells which."""
    names = [f.split()[0] for f in _ASSEMBLY.split(", ")]

    @F.pandas_udf(f"struct<{_ASSEMBLY.replace(' ', ':').replace(',:', ',')}>")
    def run(a: pd.Series, qa: pd.Series, b: pd.Series, qb: pd.Series) -> pd.DataFrame:
        rows = []
        for s, p, t, q in zip(a, qa, b, qb):
            d = assemble(s, p, t, q, min_overlap, min_identity, delta, gap, fast)
            rows.append([d.get(n) for n in names])
        frame = pd.DataFrame(rows, columns=names)
        for n in ("score", "ali_length", "seq_a_single", "seq_b_single", "seq_ab_match", "pairing_fast_count", "pairing_fast_overlap"):
            frame[n] = frame[n].astype("Int32")
        return frame

    out = pairs.withColumn("__a", run("sequence", "qualities", revcomp("mate.sequence"), F.reverse("mate.qualities")))
    out = out.withColumns({"sequence": F.col("__a.sequence"), "qualities": F.col("__a.qualities")})
    keys = {"mode": F.col("__a.mode")}
    if with_stats:
        keys |= {n: F.col(f"__a.{n}") for n in names if n not in ("mode", "sequence", "qualities")}
    return set_attributes(out, keys).drop("__a", "mate")


@dataclass(frozen=True)
class Marker:
    """A primer pair and how its tags are found and compared."""

    forward: str
    reverse: str
    errors: int = 2
    indels: bool = False
    forward_tag_length: int = 0
    reverse_tag_length: int = 0
    forward_spacer: int = 0
    reverse_spacer: int = 0
    forward_delimiter: str = ""
    reverse_delimiter: str = ""
    matching: str = "strict"  # strict, hamming or indel
    samples: tuple = field(default=())  # (forward tag, reverse tag, experiment, sample)


def _tag_before(s: str, end: int, length: int, spacer: int, delimiter: str) -> str:
    """The tag that ends ``spacer`` bases before ``end``; with a delimiter what stands between two runs of it."""
    if delimiter:
        head = s[:end].rstrip(delimiter)
        at = head.rfind(delimiter)
        return head[at + 1 :] if at >= 0 and len(head) < end else ""
    stop = end - spacer
    return s[stop - length : stop] if length and stop - length >= 0 else ""


def barcodes(s: str, markers: list[tuple]) -> list[dict]:
    """Amplicons of a read: each forward primer with the next reverse one of its marker and direction, no other primer between them."""
    hits = []
    for k, (m, f, r) in enumerate(markers):
        for p, side, strand in ((f, "open", "forward"), (r.reverse_complement(), "close", "forward"), (r, "open", "reverse"), (f.reverse_complement(), "close", "reverse")):
            hits += [(a, b, e, k, side, strand) for a, b, e in _separate(find_all(p, s))]
    hits.sort()
    found, before = [], None
    for h in hits:
        if h[4] == "open":
            before = h
        elif before is not None and before[3] == h[3] and before[5] == h[5] and h[0] > before[1]:
            m = markers[h[3]][0]
            back = _rc(s)
            left = (before[0], before[1], before[2])
            right = (len(s) - h[1], len(s) - h[0], h[2])  # places on the other strand
            first, second = (m.forward_tag_length, m.forward_spacer, m.forward_delimiter), (m.reverse_tag_length, m.reverse_spacer, m.reverse_delimiter)
            if h[5] == "reverse":
                first, second = second, first
            tag_l, tag_r = _tag_before(s, left[0], *first), _tag_before(back, right[0], *second)
            piece, match_l, match_r = s[before[1] : h[0]], s[left[0] : left[1]], back[right[0] : right[1]]
            if h[5] == "reverse":
                piece, tag_l, tag_r, match_l, match_r, left, right = _rc(piece), tag_r, tag_l, match_r, match_l, right, left
            found.append({"barcode": piece, "marker": h[3], "direction": h[5], "forward_tag": tag_l, "reverse_tag": tag_r, "forward_match": match_l, "reverse_match": match_r, "forward_error": left[2], "reverse_error": right[2], "start": before[1], "end": h[0]})
            before = None
        else:
            before = None
    return [d | {"rank": f"{i + 1}/{len(found)}"} for i, d in enumerate(found)] or [{"error": "no primer match"}]


def _separate(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    kept: list[tuple[int, int, int]] = []
    for h in sorted(hits, key=lambda h: (h[2], h[0])):
        if all(h[1] <= k[0] or k[1] <= h[0] for k in kept):
            kept.append(h)
    return kept


def _nearest(df: DataFrame, tags: DataFrame, side: str, mode: str) -> DataFrame:
    """The sheet's tag for what was read: itself, or the nearest by distance if there is only one such; else null."""
    read, known = F.col(f"{side}_tag"), F.col("__tag")
    own = tags.where(F.col("side") == side).select(F.col("marker").alias("__m"), F.col("tag").alias("__tag"))
    if mode == "strict":
        return df.withColumn(f"__{side}", read)
    seen = df.select("marker", f"{side}_tag").distinct()  # few distinct reads of a tag meet a sheet of few tags
    distance = hamming(read, known) if mode == "hamming" else F.levenshtein(read, known)
    near = seen.join(F.broadcast(own), F.col("marker") == F.col("__m")).groupBy("marker", f"{side}_tag").agg(F.array_sort(F.collect_list(F.struct(distance.alias("d"), "__tag"))).alias("c"))
    unique = (F.size("c") == 1) | (F.try_element_at("c", F.lit(1))["d"] < F.try_element_at("c", F.lit(2))["d"])
    picked = near.select("marker", f"{side}_tag", F.when(unique, F.element_at("c", 1)["__tag"]).alias(f"__{side}"))
    return df.join(picked, ["marker", f"{side}_tag"], "left")


MAX_SHEET = 20_000


def demultiplex(df: DataFrame, markers: list[Marker], keep_errors: bool = False) -> DataFrame:
    """One record per amplicon: the barcode, turned to the forward primer's strand, with its sample; reads without one are errors.

    Primers and tags are found beside the record; samples come from a join with the sheet, which is
    configuration of at most MAX_SHEET rows and broadcast.
    """
    if sum(len(m.samples) for m in markers) > MAX_SHEET:
        raise ValueError(f"a tag sheet has at most {MAX_SHEET} rows")
    compiled = [(m, compile_pattern(m.forward, m.errors, m.indels), compile_pattern(m.reverse, m.errors, m.indels)) for m in markers]
    made = "barcode string, marker int, direction string, forward_tag string, reverse_tag string, forward_match string, reverse_match string, forward_error int, reverse_error int, start int, end int, rank string, error string"
    out = flat_map(df, lambda s: barcodes(s, compiled), made)
    spark = df.sparkSession
    sheet = spark.createDataFrame([(k, f, r, e, s) for k, m in enumerate(markers) for f, r, e, s in m.samples], "marker int, __forward string, __reverse string, experiment string, sample string")
    tags = spark.createDataFrame(sorted({(k, side, t) for k, m in enumerate(markers) for f, r, *_ in m.samples for side, t in (("forward", f), ("reverse", r))}), "marker int, side string, tag string")
    for side in ("forward", "reverse"):
        modes = {m.matching for m in markers}
        if len(modes) > 1:
            raise ValueError("the markers of one call compare tags in one way")
        out = _nearest(out, tags, side, modes.pop() if modes else "strict")
    out = out.join(F.broadcast(sheet), ["marker", "__forward", "__reverse"], "left")
    error = F.coalesce("error", F.when(F.col("sample").isNull(), F.lit("no sample for the tags")))
    a, n = F.col("start") + 1, F.col("end") - F.col("start")
    q = F.slice("qualities", a, n)
    good = F.col("barcode").isNotNull()
    out = out.withColumns({"__error": error, "id": F.when(good, F.format_string("%s_sub[%d..%d]", "id", a, F.col("end"))).otherwise(F.col("id")), "qualities": F.when(good, F.when(F.col("direction") == "reverse", F.reverse(q)).otherwise(q)).otherwise(F.col("qualities")), "sequence": F.coalesce("barcode", "sequence")})
    primer = lambda part: F.element_at(F.array(*[F.lit(getattr(m, part)) for m in markers]), F.col("marker") + 1)
    keys = {c: F.col(c) for c in ("direction", "forward_tag", "reverse_tag", "forward_match", "reverse_match", "forward_error", "reverse_error", "experiment", "sample")}
    keys |= {"forward_primer": F.when(good, primer("forward")), "reverse_primer": F.when(good, primer("reverse")), "demultiplex_amplicon_rank": F.col("rank"), "demultiplex_error": F.col("__error")}
    out = set_attributes(out, keys)
    return (out if keep_errors else out.where("__error is null")).select(*df.columns)


def tag_mates(pairs: DataFrame, markers: list[Marker], reorient: bool = False, **assembly) -> DataFrame:
    """Samples of pairs by their assembled reads; the mates keep their sequences and get the tags. Only pairs with one barcode are kept."""
    whole = assemble_pairs(pairs, with_stats=False, **assembly)
    found = demultiplex(whole.withColumn("definition", F.col("id")), markers)
    notes = found.groupBy(F.col("definition").alias("__id")).agg(F.count(F.lit(1)).alias("__n"), F.any_value("annotations").alias("__notes")).where("__n = 1")
    out = pairs.join(notes, F.col("id") == F.col("__id"))
    keys = F.map_keys("__notes")
    merged = lambda old: F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(keys, k)), "__notes")
    turn = F.lit(reorient) & (F.get_json_object(F.try_element_at("__notes", F.lit("direction")), "$") == "reverse")
    own, mate = F.struct("id", "sequence", "qualities", merged("annotations").alias("annotations")), F.struct("mate.id", "mate.sequence", "mate.qualities", merged("mate.annotations").alias("annotations"))
    out = out.withColumns({"__f": F.when(turn, mate).otherwise(own), "__r": F.when(turn, own).otherwise(mate)})
    return out.withColumns({c: F.col(f"__f.{c}") for c in ("id", "sequence", "qualities", "annotations")} | {"mate": F.col("__r")}).select(*pairs.columns)
