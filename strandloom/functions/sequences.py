"""Column functions over nucleotide strings: built-in expressions only, so they stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC alphabet, each letter's complement, and the bases each letter stands for.
LETTERS = "acgturyswkmbdhvn[]"
COMPLEMENTS = "tgcaayrswmkvhdbn]["
IUPAC = {
    "a": "a", "c": "c", "g": "g", "t": "t", "u": "t", "r": "ag", "y": "ct", "s": "cg", "w": "at", "k": "gt", "m": "ac",
    "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt",
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(s: Column | str) -> Column:
    """Reverse complement; dots and dashes stay, brackets swap, other characters become n."""
    known = F.regexp_replace(F.lower(_col(s)), r"[^acgturyswkmbdhvn.\-\[\]]", "n")
    return F.reverse(F.translate(known, LETTERS, COMPLEMENTS))


def composition(s: Column | str) -> Column:
    """Map of the numbers of a, c, g, t and o, all others."""
    s = F.lower(_col(s))
    counts = {b: (F.length(s) - F.length(F.translate(s, b, ""))).cast("bigint") for b in "acgt"}
    others = F.length(F.translate(s, "acgt", "")).cast("bigint")
    return F.create_map(*[x for b, n in (counts | {"o": others}).items() for x in (F.lit(b), n)])


def _number(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def gc(s: Column | str) -> Column:
    """Share of g and c among a, c, g and t; null if there are none of those."""
    s = F.lower(_col(s))
    return F.try_divide(_number(s, "gc").cast("double"), _number(s, "acgt").cast("double"))


def gc_skew(s: Column | str) -> Column:
    """(g - c) / (g + c); null without either."""
    s = F.lower(_col(s))
    return F.try_divide((_number(s, "g") - _number(s, "c")).cast("double"), _number(s, "gc").cast("double"))


def is_valid(s: Column | str) -> Column:
    return _col(s).rlike(r"^[a-z.\-\[\]]*$")


_WINDOW = 128


def kmers(s: Column | str, k: int) -> Column:
    """Array of all substrings of length k, in order. They are cut out of short windows, as a place in a long text is found by counting from its start."""
    s = _col(s)
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - k) / _WINDOW).cast("int")), lambda w: F.substr(s, w * _WINDOW + 1, F.lit(_WINDOW + k - 1)))
    inside = F.flatten(F.transform(windows, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - k + 1), lambda i: F.substr(x, i, F.lit(k)))))
    return F.when(F.length(s) >= k, inside).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer over acgt and its reverse complement."""
    kmer = _col(kmer)
    return F.least(kmer, F.reverse(F.translate(kmer, "acgt", "tgca")))


def canonical_kmers(s: Column | str, k: int) -> Column:
    return F.transform(kmers(F.regexp_replace(F.translate(F.lower(_col(s)), "u", "t"), "[^acgt]", "a"), k), canonical)


def encode_kmer(kmer: Column | str) -> Column:
    """Two bits a base, a = 0, c = 1, g = 2, t = 3; up to 31 bases."""
    return F.conv(F.translate(_col(kmer), "acgtu", "01233"), 4, 10).cast("bigint")


def decode_kmer(code: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(code).cast("string"), 10, 4), k, "0"), "0123", "acgt")


def smallest_rotation(s: Column | str) -> Column:
    """Circular normal form: the smallest of all rotations."""
    s = _col(s)
    return F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, i), F.substr(s, F.lit(1), i - 1))))


def smallest_rotation_both(s: Column | str) -> Column:
    """The smallest rotation over both strands."""
    return F.least(smallest_rotation(s), smallest_rotation(revcomp(s)))


def iupac_regex(pattern: str) -> str:
    """A regular expression of a pattern: IUPAC letters, ``[..]`` alternatives, ``!x`` negations; ``#`` marks have no meaning without errors."""
    out, i, p = [], 0, pattern.lower()
    while i < len(p):
        negated = p[i] == "!"
        i += negated
        if p[i] == "[":
            end = p.index("]", i)
            letters, i = p[i + 1 : end], end + 1
        else:
            letters, i = p[i], i + 1
        i += i < len(p) and p[i] == "#"
        bases = "".join(sorted({b for c in letters for b in IUPAC[c]} ^ (set("acgt") if negated else set())))
        # a sequence letter matches if it may stand for one of the bases
        matching = "".join(c for c, own in IUPAC.items() if set(own) & set(bases))
        out.append(f"[{matching}]")
    return "".join(out)


def fragment(s: Column | str, length: int, overlap: int) -> Column:
    """Array of (start, sequence): windows of ``length`` that share ``overlap``; the last two are one if the rest is shorter than a window."""
    s, step = _col(s), length - overlap
    n = F.greatest(F.floor((F.length(s) - length) / step) + 1, F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(((i - 1) * step).alias("start"), F.when(i == n, F.substr(s, (i - 1) * step + 1)).otherwise(F.substr(s, (i - 1) * step + 1, F.lit(length))).alias("sequence")))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing positions; texts of unequal length differ in all of the longer."""
    a, b = _col(a), _col(b)
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), differ).otherwise(F.greatest(F.length(a), F.length(b)))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)

