"""Adapter trimming of read pairs by their overlap, and of single reads by a known adapter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandloom.kernels.assembly import assemble_adapter

# The usual adapters.
ADAPTERS = ("AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTA")

_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


@dataclass(frozen=True)
class Options:
    tail_match: float = 0.7
    insert_match: float = 0.9
    adapter_match: float = 0.8
    check: int = 16
    head: int = 16
    least_adapter: int = 5
    least_read: int = 0
    pairs_for_detection: int = 10_000

    def __post_init__(self) -> None:
        for r in (self.tail_match, self.insert_match, self.adapter_match):
            if not 0 <= r <= 1:
                raise ValueError("ratios are between 0 and 1")


def revcomp(s: str) -> str:
    return s.translate(_COMPLEMENT)[::-1]


def _code(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("latin-1", "replace"), np.uint8)


def _same(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return int((_code(a[:n]) == _code(b[:n])).sum())


def prepare(seq: str, qual: str, size: int) -> tuple[str, str]:
    """Cut to a length; unknown bases become A (a fixed rule instead of a random base)."""
    return seq[:size].upper().replace("N", "A"), qual[:size]


def candidate_ends(seq: str, mate: str, o: Options) -> set[int]:
    """Insert lengths at which ``seq`` holds the reverse complement of the mate's first bases."""
    head = _code(revcomp(mate[: o.check]))
    n = min(len(head), len(seq))
    if n == 0:
        return set()
    windows = np.lib.stride_tricks.sliding_window_view(_code(seq), n)
    share = (windows == head[:n]).mean(axis=1)
    return set((np.flatnonzero(share >= o.tail_match) + n).tolist())


def insert_ends(fwd: str, rev: str, o: Options) -> list[int]:
    """Insert lengths both mates agree on, longest first."""
    return sorted(candidate_ends(fwd, rev, o) & candidate_ends(rev, fwd, o), reverse=True)


def insert_matches(fwd: str, rev: str, end: int, o: Options) -> bool:
    return _same(revcomp(fwd[:end]), rev[:end]) / end >= o.insert_match


def trim_end(fwd: str, rev: str, adapters: tuple[str, str], o: Options) -> int:
    """How much of a pair is insert: the longest agreed length that is followed by an adapter, else an
    adapter near the reads' heads if no length is agreed on, else the whole length."""
    ends = insert_ends(fwd, rev, o)
    for end in ends:
        if end < len(fwd) and insert_matches(fwd, rev, end, o):
            for s, a in ((fwd, adapters[0]), (rev, adapters[1])):
                n = min(len(s) - end, len(a))
                if n and _same(s[end : end + n], a) / n >= o.adapter_match:
                    return end
    if not ends:
        for s, a in ((fwd, adapters[0]), (rev, adapters[1])):
            for at in range(o.head):
                n = min(len(s[: 2 * o.head]) - at, len(a), o.head)
                if n < o.least_adapter:
                    break
                if _same(s[at : at + n], a[:n]) / n >= o.adapter_match:
                    return at
    return len(fwd)


def tails(fwd: str, rev: str, o: Options) -> tuple[str, str] | None:
    """What stands behind the insert in both mates, if anything."""
    for end in insert_ends(fwd, rev, o):
        if insert_matches(fwd, rev, end, o):
            return (fwd[end:], rev[end:]) if end < len(fwd) else None
    return None


def detect(pairs: list[tuple[str, str]], o: Options = Options(), sensitive: bool = False) -> tuple[str, str]:
    """The adapters of both mates from a bounded number of pairs, of equal length; the usual ones if unclear."""
    found = [t for f, r in pairs if (t := tails(f, r, o)) is not None]
    a, b = (assemble_adapter([t[i] for t in found], sensitive=sensitive) for i in (0, 1))
    if not a or not b:
        a, b = ADAPTERS
    n = min(len(a), len(b))
    return a[:n], b[:n]


def trim_pair(fwd: tuple[str, str], rev: tuple[str, str], adapters: tuple[str, str], o: Options = Options()) -> tuple[tuple[str, str], tuple[str, str], int]:
    size = min(len(fwd[0]), len(rev[0]))
    f, r = prepare(*fwd, size), prepare(*rev, size)
    end = trim_end(f[0], r[0], adapters, o)
    end = 0 if end < o.least_read else end
    return (f[0][:end], f[1][:end]), (r[0][:end], r[1][:end]), end


def single_end(seq: str, adapter: str, error: float = 0.1, gaps: float = 0.03, least: int = 5) -> int:
    """Where the adapter begins in a read's 3' end, by semi-global alignment; the read's length without one.

    The adapter may run over the end. Errors (mismatches and gaps) may be ``error`` of the part
    compared, gaps ``gaps`` of it.
    """
    n, m = len(seq), len(adapter)
    if not n or not m:
        return n
    best = (0.0, n)
    # errors, gaps and begin of the best alignment of adapter[:j] that ends at a place of the read
    row = [(0, 0, i) for i in range(n + 1)]
    rows = [row]
    for j in range(1, m + 1):
        prev, now = rows[-1], [(j, j, 0)]
        for i in range(1, n + 1):
            diag, up, left = prev[i - 1], prev[i], now[i - 1]
            ways = [(diag[0] + (seq[i - 1] != adapter[j - 1]), diag[1], diag[2]), (up[0] + 1, up[1] + 1, up[2]), (left[0] + 1, left[1] + 1, left[2])]
            now.append(min(ways))
        rows.append(now)
    for j, i in [(j, n) for j in range(least, m + 1)] + [(m, i) for i in range(1, n)]:
        e, g, at = rows[j][i]
        if e <= error * j and g <= gaps * j:
            score = j - 2.0 * e
            if score > best[0] or (score == best[0] and at < best[1]):
                best = (score, at)
    return best[1]
