"""Consensus by De Bruijn graphs."""

from __future__ import annotations

from collections import Counter


def longest_repeat(s: str) -> int:
    """Length of the longest substring that occurs twice, by bisection over hashed windows."""
    low, high = 0, max(len(s) - 1, 0)
    while low < high:
        k = (low + high + 1) // 2
        seen, twice = set(), False
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if w in seen:
                twice = True
                break
            seen.add(w)
        low, high = (k, high) if twice else (low, k - 1)
    return low


class DeBruijn:
    """k-mers with weights; an edge where one's last k - 1 letters are another's first."""

    def __init__(self, k: int):
        self.k = k
        self.weight: Counter[str] = Counter()

    def add(self, s: str, n: int = 1) -> None:
        for i in range(len(s) - self.k + 1):
            w = s[i : i + self.k]
            if not set(w) - set("acgt"):
                self.weight[w] += n

    def next(self, w: str) -> list[str]:
        return [x for b in "acgt" if (x := w[1:] + b) in self.weight]

    def previous(self, w: str) -> list[str]:
        return [x for b in "acgt" if (x := b + w[:-1]) in self.weight]

    def order(self) -> list[str] | None:
        """Topological order, or None if there is a cycle."""
        waiting = {w: len(self.previous(w)) for w in self.weight}
        ready, out = sorted(w for w, n in waiting.items() if not n), []
        while ready:
            w = ready.pop()
            out.append(w)
            for x in self.next(w):
                waiting[x] -= 1
                if not waiting[x]:
                    ready.append(x)
        return out if len(out) == len(self.weight) else None

    def heaviest_path(self) -> list[str]:
        """The path of the largest total weight in a graph without cycles."""
        order = self.order()
        if order is None:
            raise ValueError("the graph has a cycle")
        best: dict[str, tuple[int, str | None]] = {}
        for w in order:
            before = max(((best[p][0], p) for p in self.previous(w)), default=(0, None))
            best[w] = (before[0] + self.weight[w], before[1])
        at = max(best, key=lambda w: (best[w][0], w), default=None)
        path = []
        while at is not None:
            path.append(at)
            at = best[at][1]
        return path[::-1]

    def mode(self) -> int:
        """The most frequent weight, the largest of equally frequent ones; weights of one do not count unless there are no others."""
        counts = Counter(w for w in self.weight.values() if w > 1) or Counter(self.weight.values())
        return max(counts, key=lambda w: (counts[w], w), default=0)

    def spectrum(self) -> dict[int, int]:
        return dict(Counter(self.weight.values()))

    def drop_below(self, n: float) -> None:
        self.weight = Counter({w: c for w, c in self.weight.items() if c >= n})

    def gml(self) -> str:
        ids = {w: i for i, w in enumerate(sorted(self.weight))}
        nodes = "".join(f'node [ id {i} label "{w}" weight {self.weight[w]} ]\n' for w, i in ids.items())
        edges = "".join(f'edge [ source {ids[w]} target {ids[x]} label "{x[-1]}" weight {self.weight[x]} ]\n' for w in ids for x in self.next(w))
        return f"graph [\ndirected 1\n{nodes}{edges}]\n"


def spell(path: list[str]) -> str:
    return path[0] + "".join(w[-1] for w in path[1:]) if path else ""


def consensus(sequences: list[tuple[str, int]], k: int | None = None, low_coverage: float = 0.0) -> tuple[str, dict]:
    """(sequence, facts) of weighted sequences: k is one more than the longest repeat and grows until the graph has no cycle; a single sequence is its own."""
    longest = max((len(s) for s, _ in sequences), default=0)
    if len(sequences) == 1:
        return sequences[0][0], {"kmer_size": 0, "kmer_max_occur": sequences[0][1], "filtered_graph_size": 0, "full_graph_size": 0}
    size = k or max(longest_repeat(s) for s, _ in sequences) + 1
    while size <= longest:
        graph = DeBruijn(size)
        for s, n in sequences:
            graph.add(s, n)
        if graph.weight and graph.order() is not None:
            break
        size += 1
    else:
        best = max(sequences, key=lambda x: (x[1], x[0]))
        return best[0], {"kmer_size": 0, "kmer_max_occur": best[1], "filtered_graph_size": 0, "full_graph_size": 0}
    whole = len(graph.weight)
    if low_coverage > 0:
        graph.drop_below(graph.mode() * low_coverage)
    return spell(graph.heaviest_path()), {"kmer_size": size, "kmer_max_occur": max(graph.weight.values(), default=0), "filtered_graph_size": len(graph.weight), "full_graph_size": whole}
