"""Approximate search of IUPAC patterns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from strandloom.kernels.distance import BASES, masks

_COMPLEMENT = {1: 8, 8: 1, 2: 4, 4: 2}
MAX_LENGTH = 64


@dataclass(frozen=True)
class Pattern:
    """Sets of bases by position, and where no error is allowed."""

    sets: tuple[int, ...]
    fixed: tuple[bool, ...]
    errors: int = 0
    indels: bool = False

    def __len__(self) -> int:
        return len(self.sets)

    def reverse_complement(self) -> Pattern:
        flipped = tuple(sum(_COMPLEMENT[b] for b in (1, 2, 4, 8) if s & b) for s in reversed(self.sets))
        return Pattern(flipped, tuple(reversed(self.fixed)), self.errors, self.indels)


@lru_cache(maxsize=1024)
def compile_pattern(text: str, errors: int = 0, indels: bool = False) -> Pattern:
    """IUPAC letters, ``[..]`` alternatives, ``!x`` negation, ``x#`` for a position without errors."""
    sets, fixed, i, p = [], [], 0, text.lower()
    while i < len(p):
        negated = p[i] == "!"
        i += negated
        if i >= len(p):
            raise ValueError(f"the pattern {text!r} ends early")
        if p[i] == "[":
            end = p.find("]", i)
            if end < 0:
                raise ValueError(f"the pattern {text!r} lacks a bracket")
            letters, i = p[i + 1 : end], end + 1
        else:
            letters, i = p[i], i + 1
        if any(c not in BASES for c in letters):
            raise ValueError(f"the pattern {text!r} has letters beyond IUPAC")
        s = 0
        for c in letters:
            s |= BASES[c]
        sets.append(15 ^ s if negated else s)
        fixed.append(i < len(p) and p[i] == "#")
        i += fixed[-1]
    if not 0 < len(sets) <= MAX_LENGTH:
        raise ValueError(f"a pattern has 1 to {MAX_LENGTH} positions")
    return Pattern(tuple(sets), tuple(fixed), errors, indels)


def find_all(pattern: Pattern, sequence: str, begin: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, errors) of every hit in sequence[begin:end]; with indels one per end position."""
    s = masks(sequence)[begin:end]
    m, n = len(pattern), len(s)
    if not pattern.indels:
        if n < m:
            return []
        errors = np.zeros(n - m + 1, np.int64)
        barred = np.zeros(n - m + 1, bool)
        for j, (bits, must) in enumerate(zip(pattern.sets, pattern.fixed)):
            miss = (s[j : n - m + 1 + j] & bits) == 0
            if must:
                barred |= miss
            else:
                errors += miss
        hits = np.flatnonzero(~barred & (errors <= pattern.errors))
        return [(begin + int(i), begin + int(i) + m, int(errors[i])) for i in hits]
    # edits by columns of the text: cost and start of the best alignment that ends here
    far = m + n + 1
    cost = [0 if not any(pattern.fixed[:i]) else far for i in range(1)] + [far if any(pattern.fixed[:i]) else i for i in range(1, m + 1)]
    start = [0] * (m + 1)
    hits = []
    sets, fixed = pattern.sets, pattern.fixed
    for j in range(n):
        c = int(s[j])
        diag_cost, diag_start = cost[0], start[0]
        cost[0], start[0] = 0, j + 1
        for i in range(1, m + 1):
            up_cost, up_start = cost[i], start[i]
            match = c & sets[i - 1]
            best, at = diag_cost + (0 if match else far if fixed[i - 1] else 1), diag_start
            if up_cost + 1 < best:  # a letter of the text beyond the pattern
                best, at = up_cost + 1, up_start
            if not fixed[i - 1] and cost[i - 1] + 1 < best:  # a position of the pattern left out
                best, at = cost[i - 1] + 1, start[i - 1]
            diag_cost, diag_start = up_cost, up_start
            cost[i], start[i] = best, at
        if cost[m] <= pattern.errors:
            hits.append((begin + start[m], begin + j + 1, cost[m]))
    return hits


def best_match(pattern: Pattern, sequence: str, begin: int = 0, end: int | None = None) -> tuple[int, int, int] | None:
    """The first hit with the fewest errors."""
    hits = find_all(pattern, sequence, begin, end)
    return min(hits, key=lambda h: (h[2], h[0], h[1])) if hits else None


def best_matches(pattern: Pattern, sequence: str, begin: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """Hits that do not overlap: of overlapping ones the one with the fewest errors, then the first."""
    kept: list[tuple[int, int, int]] = []
    for h in sorted(find_all(pattern, sequence, begin, end), key=lambda h: (h[2], h[0], h[1])):
        if all(h[1] <= k[0] or k[1] <= h[0] for k in kept):
            kept.append(h)
    return sorted(kept)
