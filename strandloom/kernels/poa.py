"""Partial-order alignment: a graph grows by one sequence at a time, and gives an MSA and a consensus."""

from __future__ import annotations

import numpy as np

LOW = -(10**9)


class Graph:
    """Nodes in insertion order; ``column`` groups the nodes that stand for one position."""

    def __init__(self) -> None:
        self.letter: list[str] = []
        self.into: list[list[int]] = []
        self.out: list[list[int]] = []
        self.weight: dict[tuple[int, int], float] = {}
        self.group: list[int] = []  # index in groups
        self.groups: list[list[int]] = []
        self.paths: list[list[int]] = []
        self.used: list[int] = []  # how many sequences go through a node
        self.straight = True  # all sequences go through all groups, one after another

    def _node(self, letter: str, group: int | None = None) -> int:
        n = len(self.letter)
        self.letter.append(letter)
        self.into.append([])
        self.out.append([])
        self.used.append(0)
        if group is None:
            group = len(self.groups)
            self.groups.append([])
        self.groups[group].append(n)
        self.group.append(group)
        return n

    def _edge(self, a: int, b: int, w: float) -> None:
        if (a, b) not in self.weight:
            self.out[a].append(b)
            self.into[b].append(a)
        self.weight[a, b] = self.weight.get((a, b), 0) + w

    def add(self, seq: str, alignment: list[tuple[int, int]] | None = None, weights: list[float] | float = 1) -> None:
        """Threads a sequence through the graph along (node, place) steps, -1 for a gap on either side."""
        if not seq:
            return
        w = [weights] * len(seq) if isinstance(weights, (int, float)) else list(weights)
        if len(w) != len(seq):
            raise ValueError("a weight for each letter, please")
        at = {p: n for n, p in alignment or [] if p >= 0}
        path: list[int] = []
        for p, c in enumerate(seq):
            n = at.get(p, -1)
            if n >= 0 and self.letter[n] != c:
                same = [x for x in self.groups[self.group[n]] if self.letter[x] == c]
                n = same[0] if same else self._node(c, self.group[n])
            elif n < 0:
                n = self._node(c)
            self.used[n] += 1
            if path:
                self._edge(path[-1], n, w[p - 1] + w[p])
            path.append(n)
        self.paths.append(path)
        self.straight = self.straight and [self.group[n] for n in path] == list(range(len(self.groups)))

    def order(self) -> list[int]:
        """Topological order in which the nodes of a group stand together."""
        need = [0] * len(self.groups)
        for g, nodes in enumerate(self.groups):
            need[g] = sum(len(self.into[n]) for n in nodes)
        ready = [g for g in range(len(self.groups)) if not need[g]]
        out: list[int] = []
        k = 0
        while k < len(ready):
            for n in self.groups[ready[k]]:
                out.append(n)
                for m in self.out[n]:
                    g = self.group[m]
                    need[g] -= 1
                    if not need[g]:
                        ready.append(g)
            k += 1
        if len(out) != len(self.letter):
            raise RuntimeError("the graph has a cycle")
        return out

    def align(self, seq: str, match: int = 5, mismatch: int = -4, gap: int = -8, extend: int | None = None, local: bool = False) -> list[tuple[int, int]]:
        """Best (node, place) steps of ``seq``. Gaps must not be positive; ``gap >= extend`` means linear ones."""
        extend = gap if extend is None or gap >= extend else extend
        if gap > 0 or extend > 0:
            raise ValueError("gap penalties must not be positive")
        if not seq or not self.letter:
            return []
        if not local and (steps := self._without_gaps(seq, match, mismatch, gap)):
            return steps
        order = self.order()
        row = {n: i + 1 for i, n in enumerate(order)}
        m = len(seq)
        letters = np.frombuffer(seq.encode("latin-1"), np.uint8)
        steps = np.arange(m + 1)
        lead = np.where(steps > 0, gap + (steps - 1) * extend, 0)
        H = np.full((len(order) + 1, m + 1), LOW, np.int64)
        F = np.full((len(order) + 1, m + 1), LOW, np.int64)
        H[0] = 0 if local else lead
        for i, n in enumerate(order, 1):
            before = [row[p] for p in self.into[n]] or [0]
            f = np.max([np.maximum(H[p] + gap, F[p] + extend) for p in before], axis=0)
            if local:
                f[0] = 0
            score = np.where(letters == ord(self.letter[n]), match, mismatch)
            diag = np.full(m + 1, LOW, np.int64)
            diag[1:] = np.max([H[p, :-1] for p in before], axis=0) + score
            h = np.maximum(diag, f)
            if local:
                h = np.maximum(h, 0)
            # gaps in the graph: the best earlier cell, by a running maximum
            lifted = np.maximum.accumulate(h - extend * steps)
            e = np.full(m + 1, LOW, np.int64)
            e[1:] = lifted[:-1] + extend * (steps[1:] - 1) + gap
            H[i], F[i] = np.maximum(h, e), f
        ends = [row[n] for n in order if not self.out[n]]
        if local:
            best = max(((int(H[i].max()), -i, -int(H[i].argmax())) for i in range(1, len(order) + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i, j = -best[1], -best[2]
        else:
            i, j = max(ends, key=lambda r: (int(H[r, m]), -r)), m
        return self._trace(order, row, H, F, i, j, letters, match, mismatch, gap, extend, local)

    def _without_gaps(self, seq: str, match: int, mismatch: int, gap: int) -> list[tuple[int, int]]:
        """The steps of ``align`` if no alignment with gaps can be as good, else none.

        All ways through a straight graph are equally long. On a sequence of that length gaps come in
        pairs, so at least one letter is unmatched and two gaps are opened.
        """
        if not self.straight or len(self.groups) != len(seq) or match < max(0, mismatch):
            return []
        best: dict[int, int] = {}
        for c, nodes in zip(seq, self.groups):
            for n in nodes:
                best[n] = max([best[p] for p in self.into[n]], default=0) + (match if self.letter[n] == c else mismatch)
        n = max(self.groups[-1], key=lambda n: best[n])
        if best[n] <= match * (len(seq) - 1) + 2 * gap:
            return []
        steps = [(n, len(seq) - 1)]
        while self.into[n]:
            n = max(self.into[n], key=lambda p: best[p])
            steps.append((n, steps[-1][1] - 1))
        return steps[::-1]

    def _trace(self, order, row, H, F, i, j, letters, match, mismatch, gap, extend, local) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        while (i or j) and not (local and H[i, j] <= 0):
            if i == 0:
                out += [(-1, p) for p in range(j - 1, -1, -1)]
                break
            n = order[i - 1]
            before = [row[p] for p in self.into[n]] or [0]
            h = H[i, j]
            if j:
                s = match if letters[j - 1] == ord(self.letter[n]) else mismatch
                p = next((p for p in before if H[p, j - 1] + s == h), None)
                if p is not None:
                    out.append((n, j - 1))
                    i, j = p, j - 1
                    continue
            if F[i, j] == h:
                f = h
                while True:
                    n = order[i - 1]
                    before = [row[p] for p in self.into[n]] or [0]
                    out.append((n, -1))
                    p = next((p for p in before if H[p, j] + gap == f), None)
                    if p is not None:
                        i = p
                        break
                    p = next(p for p in before if F[p, j] + extend == f)
                    i, f = p, F[p, j]
                continue
            k = next(k for k in range(1, j + 1) if H[i, j - k] + gap + (k - 1) * extend == h)
            out += [(-1, j - x) for x in range(1, k + 1)]
            j -= k
        return out[::-1]

    def msa(self, with_consensus: bool = False) -> list[str]:
        """A row for each sequence added (empty ones apart), and the consensus on request."""
        column: dict[int, int] = {}
        for n in self.order():
            column.setdefault(self.group[n], len(column))

        def show(path: list[int]) -> str:
            line = ["-"] * len(column)
            for n in path:
                line[column[self.group[n]]] = self.letter[n]
            return "".join(line)

        rows = [show(p) for p in self.paths]
        return [*rows, show(self.consensus_path())] if with_consensus else rows

    def consensus_path(self) -> list[int]:
        """The heaviest bundle: back along the heaviest edges from the best node, then on to an end."""
        order = self.order()
        if not order:
            return []
        score, back = dict.fromkeys(order, -1.0), dict.fromkeys(order, -1)

        def best_in(n: int) -> None:
            score[n], back[n] = 0.0, -1
            for p in self.into[n]:
                if score[p] < 0:
                    continue
                w = self.weight[p, n]
                if back[n] < 0 or w > self.weight[back[n], n] or (w == self.weight[back[n], n] and score[p] > score[back[n]]):
                    back[n] = p
            if back[n] >= 0:
                score[n] = score[back[n]] + self.weight[back[n], n]

        for n in order:
            best_in(n)
        top = max(order, key=lambda n: score[n])  # the first of equal ones
        while self.out[top]:  # branch completion: only ways through the best node count
            behind = order[order.index(top) + 1 :]
            for n in order:
                if n != top and self.group[n] != self.group[top] and n not in behind:
                    score[n] = -1.0
            for n in behind:
                back[n] = -1
                ways = [p for p in self.into[n] if p == top or (p in behind and score[p] >= 0)]
                score[n] = -1.0
                if ways:
                    back[n] = max(ways, key=lambda p: (self.weight[p, n], score[p]))
                    score[n] = max(0.0, score[back[n]]) + self.weight[back[n], n]
            reach = [n for n in behind if score[n] >= 0]
            top = max(reach, key=lambda n: score[n])
        path = [top]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        return path[::-1]

    def consensus(self, least_coverage: int = 0) -> str:
        return "".join(self.letter[n] for n in self.consensus_path() if self.used[n] >= least_coverage)

    def coverage(self) -> list[int]:
        """How many sequences go through each node of the consensus."""
        return [self.used[n] for n in self.consensus_path()]

    def subgraph(self, first: int, last: int) -> "Graph":
        """The part between two nodes in topological order."""
        order = self.order()
        keep = set(order[order.index(first) : order.index(last) + 1])
        new, name = Graph(), {}
        for n in order:
            if n in keep:
                mates = [name[x] for x in self.groups[self.group[n]] if x in name]
                name[n] = new._node(self.letter[n], new.group[mates[0]] if mates else None)
                new.used[name[n]] = self.used[n]
        for (a, b), w in self.weight.items():
            if a in keep and b in keep:
                new._edge(name[a], name[b], w)
        return new

    def dot(self) -> str:
        """The graph in DOT, aligned nodes joined by dotted lines."""
        lines = ["digraph {", "  rankdir=LR"]
        lines += [f'  n{i} [label="{i}: {c}"]' for i, c in enumerate(self.letter)]
        lines += [f'  n{a} -> n{b} [label="{w:g}"]' for (a, b), w in self.weight.items()]
        lines += [f"  n{a} -> n{b} [style=dotted, arrowhead=none]" for g in self.groups for a, b in zip(g, g[1:])]
        return "\n".join([*lines, "}"])


def build(seqs: list[str], match: int = 5, mismatch: int = -4, gap: int = -8, extend: int | None = None, local: bool = False, weights: list[list[float]] | None = None) -> Graph:
    """The graph of all sequences, added in order."""
    g = Graph()
    for i, s in enumerate(seqs):
        g.add(s, g.align(s, match, mismatch, gap, extend, local), weights[i] if weights else 1)
    return g


def build_by_edits(seqs: list[str], substitution: int = 1) -> Graph:
    """By edit distance; with a substitution at 2 a mismatch costs as much as an insertion and a deletion."""
    return build(seqs, 0, -substitution, -1)
