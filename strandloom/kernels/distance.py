"""Sequence distances."""

from __future__ import annotations

import numpy as np

# Each IUPAC letter as the set of bases it stands for, a = 1, c = 2, g = 4, t = 8.
BASES = {"a": 1, "c": 2, "g": 4, "t": 8, "u": 8, "r": 5, "y": 10, "s": 6, "w": 9, "k": 12, "m": 3, "b": 14, "d": 13, "h": 11, "v": 7, "n": 15}

_MASKS = np.zeros(256, np.uint8)
for _letter, _bits in BASES.items():
    _MASKS[ord(_letter)] = _MASKS[ord(_letter.upper())] = _bits


def masks(s: str) -> np.ndarray:
    """One bit set of bases per letter; 0 for what is no letter of the alphabet."""
    return _MASKS[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]


def one_difference(a: str, b: str) -> tuple[int, int, str, str]:
    """(distance, position, letter of a, letter of b): 0 if equal, 1 for one substitution or gap, else -1; letters are compared as they are."""
    if a == b:
        return 0, 0, "-", "-"
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return -1, 0, "-", "-"
    left, short = 0, min(la, lb)
    while left < short and a[left] == b[left]:
        left += 1
    right = 0
    while right < short - left and a[la - 1 - right] == b[lb - 1 - right]:
        right += 1
    if la == lb:
        return (1, left, a[left], b[left]) if left + right == la - 1 else (-1, 0, "-", "-")
    if left + right < short:
        return -1, 0, "-", "-"
    return (1, left, a[left], "-") if la > lb else (1, left, "-", b[left])


def lcs_distance(a: str, b: str, limit: int | None = None, end_gap_free: bool = False) -> tuple[int, int] | None:
    """(matches, alignment length) of the alignment with most matches and, of those, the shortest; None beyond ``limit`` differences.

    Letters match if they may stand for one base. Scores are packed: a match is worth more than any
    length, so one maximum does both. Rows of the matrix are computed at once: the step along a row is a
    running maximum. With ``end_gap_free`` what the longer one has beyond the shorter's ends costs nothing.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if limit is not None and not end_gap_free and n - m > limit:
        return None
    if not m:
        return None if limit is not None and n > limit and not end_gap_free else (0, 0 if end_gap_free else n)
    big = 2 * (n + m) + 2
    x, y = masks(a), masks(b)
    raw_x, raw_y = np.frombuffer(a.lower().encode("latin-1", "replace"), np.uint8), np.frombuffer(b.lower().encode("latin-1", "replace"), np.uint8)
    columns = np.arange(n + 1, dtype=np.int64)
    gap_along = np.zeros(n + 1, np.int64) if end_gap_free else columns  # the longer one's overhang
    row = -gap_along
    for i in range(m):
        same = ((x & y[i]) > 0) | (raw_x == raw_y[i])
        diagonal = row[:-1] + np.where(same, big, 0) - 1
        best = np.maximum(row[1:] - 1, diagonal)
        new = np.concatenate(([row[0] - 1], best))
        if end_gap_free and i == m - 1:
            row = np.maximum.accumulate(new)
        else:
            row = np.maximum.accumulate(new + columns) - columns
    score = int(row[n])
    matches = -(-score // big) if score > 0 else 0
    length = matches * big - score
    if limit is not None and length - matches > limit:
        return None
    return matches, length


def hamming(a: str, b: str) -> int:
    return sum(p != q for p, q in zip(a, b)) if len(a) == len(b) else max(len(a), len(b))


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (p != q))
    return row[-1]


def fourmers(s: str) -> np.ndarray:
    """Numbers of the 256 4-mers; letters but c, g, t and u count as a."""
    code = np.zeros(256, np.int64)
    for letter, v in (("c", 1), ("g", 2), ("t", 3), ("u", 3)):
        code[ord(letter)] = code[ord(letter.upper())] = v
    c = code[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    if len(c) < 4:
        return np.zeros(256, np.int64)
    return np.bincount(c[:-3] << 6 | c[1:-2] << 4 | c[2:-1] << 2 | c[3:], minlength=256)


def common_ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common beginning and end, letters matching if they may stand for one base."""
    x, y = masks(a), masks(b)
    n = min(len(x), len(y))
    head = (x[:n] & y[:n]) > 0
    tail = (x[::-1][:n] & y[::-1][:n]) > 0
    return (n if head.all() else int(head.argmin())), (n if tail.all() else int(tail.argmin()))
