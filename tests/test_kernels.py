"""Kernels against slow forms of their definitions."""

import random

from strandloom.kernels import stats
from strandloom.kernels.assembly import assemble, word_entropy
from strandloom.kernels.distance import common_ends, lcs_distance, levenshtein, one_difference
from strandloom.kernels.graphs import consensus, longest_repeat
from strandloom.kernels.patterns import best_match, best_matches, compile_pattern, find_all
from strandloom.operators.patterns import _rc, amplicons
from strandloom.operators.reads import Marker, barcodes


def slow_lcs(a, b):
    table = [[(0, -(i + j)) if not i or not j else None for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            up, left, d = table[i - 1][j], table[i][j - 1], table[i - 1][j - 1]
            table[i][j] = max((up[0], up[1] - 1), (left[0], left[1] - 1), (d[0] + (a[i - 1] == b[j - 1]), d[1] - 1))
    m, n = table[-1][-1]
    return m, -n


def test_lcs():
    assert lcs_distance("axx", "yya") == (1, 5) and lcs_distance("ab", "ba") == (1, 3) and lcs_distance("acgt", "acgn") == (4, 4)
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("acgt") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        m, n = lcs_distance(a, b)
        assert (m, n) == slow_lcs(a, b), (a, b)
        assert levenshtein(a, b) <= n - m
        assert (lcs_distance(a, b, 2) is None) == (n - m > 2)


def test_one_difference():
    assert [one_difference("acgt", x)[0] for x in ("acgt", "aagt", "act", "tgca", "acgn", "acggt")] == [0, 1, 1, -1, 1, 1]
    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("ac") for _ in range(rng.randrange(0, 7))) for _ in range(2))
        d = levenshtein(a, b)
        assert one_difference(a, b)[0] == (d if d < 2 else -1)


def test_patterns():
    p = compile_pattern("ac!g[at]n", 1)
    assert len(p) == 5 and p.reverse_complement().reverse_complement() == p
    assert find_all(compile_pattern("acgt"), "ttacgtacgt") == [(2, 6, 0), (6, 10, 0)]
    assert find_all(compile_pattern("acg#t", 1), "acat") == [] and find_all(compile_pattern("acgt", 1), "acat") == [(0, 4, 1)]
    assert best_match(compile_pattern("acgt", 1, True), "ttagttt") == (2, 5, 1)
    assert best_matches(compile_pattern("aa"), "aaaa") == [(0, 2, 0), (2, 4, 0)]
    rng = random.Random(3)
    for _ in range(100):
        s = "".join(rng.choice("acgt") for _ in range(30))
        hits = find_all(compile_pattern("acgta", 1, True), s)
        ends = {b for _, b, _ in hits}
        assert ends == {j for j in range(1, 31) if min(levenshtein("acgta", s[i:j]) for i in range(j + 1)) <= 1}
        assert all(levenshtein("acgta", s[a:b]) == e for a, b, e in hits)


def test_pcr_and_barcodes():
    f, r, inner = "ttagataccccactatgc", "tagaacaggctcctctag", "acgtacgtaagg"
    read = "gg" + f + inner + _rc(r) + "cc"
    for s, direction in ((read, "forward"), (_rc(read), "reverse")):
        hit = amplicons(s, compile_pattern(f, 2), compile_pattern(r, 2))
        assert [(h["amplicon"], h["direction"], h["forward_match"], h["reverse_match"]) for h in hit] == [(inner, direction, f, r)]
    assert amplicons("gg" + f + _rc(r), compile_pattern(f), compile_pattern(r)) == []
    m = Marker(f, r, forward_tag_length=7, reverse_tag_length=7)
    whole = "aattaac" + f + inner + _rc(r) + _rc("gaagtag")
    for s, direction in ((whole, "forward"), (_rc(whole), "reverse")):
        (b,) = barcodes(s, [(m, compile_pattern(f, 2), compile_pattern(r, 2))])
        assert (b["barcode"], b["forward_tag"], b["reverse_tag"], b["direction"]) == (inner, "aattaac", "gaagtag", direction)
    assert barcodes("acgt", [(m, compile_pattern(f), compile_pattern(r))]) == [{"error": "no primer match"}]


def test_assembly():
    rng = random.Random(4)
    whole = "".join(rng.choice("acgt") for _ in range(150))
    a, b = whole[:100], whole[60:]
    for fast in (True, False):
        d = assemble(a, None, b, None, fast=fast)
        assert d["mode"] == "alignment" and d["sequence"] == whole and d["seq_ab_match"] == 40
    worse = b[:10] + ("a" if b[10] != "a" else "c") + b[11:]
    d = assemble(a, [40] * 100, worse, [20] * 90)
    assert d["sequence"] == whole and len(d["pairing_mismatches"]) == 1
    other = "".join(rng.choice("acgt") for _ in range(80))
    d = assemble(a, None, other, None)
    assert d["mode"] == "join" and d["sequence"] == a + "." * 10 + other


def test_graphs_and_entropy():
    assert longest_repeat("acgtacg") == 3 and longest_repeat("acgt") == 0
    rng = random.Random(5)
    true = "".join(rng.choice("acgt") for _ in range(80))
    wrong = true[:40] + ("a" if true[40] != "a" else "c") + true[41:]
    assert consensus([(true, 10), (wrong, 1), (true, 3)])[0] == true
    assert word_entropy("a" * 31) == 0.0 and word_entropy(true[:31]) > 0.5


def test_stats():
    assert abs(stats.t_cdf(2.0, 10) - 0.963306) < 1e-5 and abs(stats.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-9
    u, p = stats.mann_whitney([1, 2, 3], [4, 5, 6], "less")
    assert u == 0 and abs(p - 0.05) < 1e-12
    assert stats.mann_whitney([1, 1], [1, 1])[1] == 1.0
    assert abs(stats.t_test([1, 2, 3, 4], [2, 3, 4, 6])[0] + 1.1677484) < 1e-5
    assert common_ends("acgtt", "acctt") == (2, 2)
