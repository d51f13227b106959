"""Held-out passages in scanned pages, by greedy string tiling over reading-order streams.

Seeds: of every run of ``TILE`` units of a test item the rarest word is an anchor (for scripts
without blanks the 16-letter word with the least Karp-Rabin hash), so a page that holds such a run
holds an anchor of it. Where a page's word may be an anchor the match is extended both ways, all
candidates of a batch at once: by runs of 8 units whose running Karp-Rabin hashes agree, and unit by
unit elsewhere. A page word counts as an item's word if it is equal or one letter of four or more is
misread as one or two others; as that isn't transitive, only equal words can be hashed, and misread
ones are compared.

Of a page and an item the longest match is marked, what others have left beside the marks is put
back, and so on until nothing as long as the least tile is left. The share of the item that is
marked tells of passages that were moved about; the longest tile of those that were not.

The items are the stated query set: they are held in blocks of bounded size, and each batch of pages,
read once, meets one block after another.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import layout
from strandloom.llm.sentences import SIGNS

#: Units in a row that make a leak, in words and, for scripts without blanks, in characters.
WORDS, CHARACTERS = 24, 44
#: Units of the least tile, in words and in characters.
TILE_WORDS, TILE_CHARACTERS = 12, 24
#: Share of an item's units that makes a leak although no tile is long enough.
COVERED = 0.5
GRAM = 16
#: Units of the runs that are hashed to extend matches.
RUN = 8
#: Characters of the items of one block: bounds what is sent to the executors at once.
BLOCK_CHARACTERS = 8_000_000
#: Words remembered by a worker.
MEMORY = 500_000

_BROKEN = re.compile(f"[{SIGNS}]\\s*\n")
_PUNCT = re.compile(r"[^\w\s]|_")
_WIDE = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_SPACE = re.compile(r"\s+")

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def is_wide(text: str) -> bool:
    """Whether a text is read by characters: a third of it is Han or Kana."""
    return 3 * len(_WIDE.findall(text)) > len(text) - text.count("\n")


def tokens(text: str) -> list[str]:
    """Words in lower case without punctuation, those broken at line ends made whole."""
    return _PUNCT.sub("", _BROKEN.sub("", text)).casefold().split()


def characters(text: str) -> str:
    return _SPACE.sub("", _PUNCT.sub("", _BROKEN.sub("", text)).casefold())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(code: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all runs of 16 characters, by doubling."""
    h, width, power = code.astype(_U) + _U(1), 1, _BASE
    while width < GRAM and len(h) > width:
        h = h[: len(h) - width] * power + h[width:]
        power, width = _U(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), 2 * width
    if width < GRAM:
        return h[:0]
    return (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def run_hashes(code: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of the runs of ``RUN`` units at each place, by doubling; 0 where no run fits."""
    h, width, power = code.astype(_U) + _U(1), 1, _BASE
    while width < RUN and len(h) > width:
        h = h[: len(h) - width] * power + h[width:]
        power, width = _U(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), 2 * width
    return np.r_[h if width == RUN else h[:0], np.zeros(min(len(code), RUN - 1), _U)]


def covering(rank: np.ndarray, span: int) -> np.ndarray:
    """Positions such that every run of ``span`` holds one: the rightmost least of each run."""
    if len(rank) < span:
        return np.empty(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(rank, span)
    return np.unique(np.arange(len(runs)) + span - 1 - np.argmin(runs[:, ::-1], axis=1))


@dataclass
class Items:
    """A block of test items, prepared for matching."""

    ids: list
    wide: np.ndarray
    code: np.ndarray  # words of the vocabulary, or characters, of all items one after another
    start: np.ndarray
    end: np.ndarray
    words: dict[str, int] = field(default_factory=dict)
    patterns: dict[str, list[int]] = field(default_factory=dict)
    anchor_of: dict[int, list[int]] = field(default_factory=dict)  # word to places in code
    run: np.ndarray = field(default_factory=lambda: np.empty(0, _U))  # hashes of the runs of ``RUN`` units at each place
    gram: np.ndarray = field(default_factory=lambda: np.empty(0, _U))
    gram_at: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def prepare(rows: list[tuple], words: int = TILE_WORDS, chars: int = TILE_CHARACTERS) -> Items:
    vocabulary: dict[str, int] = {}
    parts, wide = [], []
    for _, text in rows:
        w = is_wide(text or "")
        wide.append(w)
        parts.append(_codes(characters(text)).astype(np.int64) if w else np.array([vocabulary.setdefault(t, len(vocabulary)) for t in tokens(text or "")], np.int64))
    size = np.array([len(p) for p in parts], np.int64)
    end = np.cumsum(size)
    out = Items([i for i, _ in rows], np.array(wide, bool), np.concatenate(parts) if parts else np.empty(0, np.int64), end - size, end, vocabulary)
    for w, n in vocabulary.items():
        if sum(c.isalpha() for c in w) >= 4:
            for i, c in enumerate(w):
                if c.isalpha():
                    out.patterns.setdefault(f"{w[:i]}\0{w[i + 1:]}", []).append(n)
    narrow = [p for p, w in zip(parts, wide) if not w]
    often = np.bincount(np.concatenate(narrow), minlength=len(vocabulary)) if narrow else np.empty(0, np.int64)
    length = np.array([len(w) for w in vocabulary], np.int64)
    grams, at = [], []
    for p, w, s in zip(parts, wide, out.start):
        if w:
            h = gram_hashes(p)
            keep = covering(h, chars - GRAM + 1)
            grams.append(h[keep])
            at.append(keep + s)
        elif len(p) >= words:
            for q in covering(often[p] * 64 - np.minimum(length[p], 63), words):
                out.anchor_of.setdefault(int(p[q]), []).append(int(q + s))
    out.run = run_hashes(out.code)
    if grams:
        h, q = np.concatenate(grams), np.concatenate(at)
        order = np.argsort(h, kind="stable")
        out.gram, out.gram_at = h[order], q[order]
    return out


def read_as(word: str, items: Items) -> tuple[int, ...]:
    """The item words that a page's word may be, an equal one first."""
    found = {}
    if (n := items.words.get(word)) is not None:
        found[n] = True
    get = items.patterns.get
    for i in range(len(word)):
        for j in (1, 2):
            if i + j <= len(word):
                for n in get(f"{word[:i]}\0{word[i + j:]}", ()):
                    found[n] = True
    return tuple(found)


def _extend(match, p_run: np.ndarray, q_run: np.ndarray, p: np.ndarray, q: np.ndarray, low_p: np.ndarray, low_q: np.ndarray, step: int) -> np.ndarray:
    """How many units beyond each seed match in one direction; low_* are the last places allowed."""
    n = np.zeros(len(p), np.int64)
    room = np.minimum((low_p - p) * step, (low_q - q) * step)
    live = np.flatnonzero(room > 0)
    while len(live):
        d = n[live]
        far = room[live] - d >= RUN
        # the run of units that comes next, whichever way
        a, b = (x[live] + (d + 1 if step > 0 else -d - RUN) for x in (p, q))
        jump = np.zeros(len(live), bool)
        jump[far] = (p_run[a[far]] == q_run[b[far]]) & (p_run[a[far]] != 0)
        n[live[jump]] += RUN
        slow = live[~jump]
        same = match(p[slow] + step * (n[slow] + 1), q[slow] + step * (n[slow] + 1))
        n[slow[same]] += 1
        live = np.concatenate([live[jump], slow[same]])
        live = live[n[live] < room[live]]
    return n


def tiles(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """(length, page place, item place): the longest match is marked, and what others have left beside all marks waits again."""
    waiting = [(-n, p, q) for n, p, q in set(matches) if n >= least]
    heapq.heapify(waiting)
    out: list[tuple[int, int, int]] = []
    while waiting:
        n, p, q = heapq.heappop(waiting)
        n = -n
        free = [(0, n)]
        for m, a, b in out:
            for x in (a - p, b - q):  # the marked part in the match's own places
                free = [(i, j) for lo, hi in free for i, j in ((lo, min(hi, x)), (max(lo, x + m), hi)) if i < j] if x < n and x + m > 0 else free
        if free == [(0, n)]:
            out.append((n, p, q))
        else:
            for i, j in free:
                if j - i >= least:
                    heapq.heappush(waiting, (i - j, p + i, q + i))
    return out


def _matches(seed_p, seed_q, stream_of, owner, first, last, items: Items, match, p_run, least: int) -> dict[tuple[int, int], list]:
    """By (page, item) the maximal matches of at least ``least`` units through the seeds; none crosses a stream's end."""
    out: dict[tuple[int, int], list] = {}
    if not len(seed_p):
        return out
    s, j = stream_of(seed_p), np.searchsorted(items.end, seed_q, side="right")
    right = _extend(match, p_run, items.run, seed_p, seed_q, last[s] - 1, items.end[j] - 1, 1)
    left = _extend(match, p_run, items.run, seed_p, seed_q, first[s], items.start[j], -1)
    n = left + right + 1
    good = np.flatnonzero(n >= least)
    for k in set(zip(owner[s[good]].tolist(), j[good].tolist(), n[good].tolist(), (seed_p - left)[good].tolist(), (seed_q - left)[good].tolist())):
        out.setdefault(k[:2], []).append(k[2:])
    return out


@dataclass
class Words:
    """The streams of a batch that are read by words: each word is a number of ``types``."""

    types: dict[str, int]
    flat: np.ndarray
    first: np.ndarray
    last: np.ndarray
    owner: np.ndarray  # the page of each stream
    order: np.ndarray


def words_of(texts: list[str], owner: list[int]) -> Words:
    types: dict[str, int] = {}
    number = types.setdefault
    parts = [[number(t, len(types)) for t in tokens(x)] for x in texts]
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.fromiter((t for p in parts for t in p), np.int64, int(size.sum()))
    last = np.cumsum(size)
    return Words(types, flat, last - size, last, np.array(owner, np.int64), np.argsort(flat, kind="stable"))


def _word_matches(w: Words, items: Items, least: int, memory: dict) -> dict[tuple[int, int], list]:
    if not len(w.flat) or not items.anchor_of:
        return {}
    pairs_t, pairs_v, seeds_t, seeds_q = [], [], [], []
    equal = np.arange(-1, -1 - len(w.types), -1)  # numbers of items' words, and below 0 of words that no item has
    for x, t in w.types.items():
        known = memory.get(x)
        if known is None:
            if len(memory) > MEMORY:
                memory.clear()
            known = memory[x] = read_as(x, items)
        if known and x in items.words:
            equal[t] = items.words[x]
        for v in known:
            pairs_t.append(t)
            pairs_v.append(v)
            for q in items.anchor_of.get(v, ()):
                seeds_t.append(t)
                seeds_q.append(q)
    if not seeds_t:
        return {}
    width = max(1, len(items.words))
    related = np.sort(np.array(pairs_t, np.int64) * width + np.array(pairs_v, np.int64))
    p_run = run_hashes(equal[w.flat])

    def match(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = w.flat[a] * width + items.code[b]
        near = np.minimum(np.searchsorted(related, code), len(related) - 1)
        return related[near] == code

    # every place of a word times the anchors it may be
    seeds_t, seeds_q = np.array(seeds_t, np.int64), np.array(seeds_q, np.int64)
    low, high = np.searchsorted(w.flat[w.order], seeds_t), np.searchsorted(w.flat[w.order], seeds_t, side="right")
    times = high - low
    at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
    return _matches(w.order[at], np.repeat(seeds_q, times), lambda p: np.searchsorted(w.last, p, side="right"), w.owner, w.first, w.last, items, match, p_run, least)


@dataclass
class Characters:
    """The streams of a batch that are read by characters."""

    flat: np.ndarray
    first: np.ndarray
    last: np.ndarray
    owner: np.ndarray
    gram: np.ndarray
    run: np.ndarray


def characters_of(texts: list[str], owner: list[int]) -> Characters:
    parts = [_codes(characters(x)) for x in texts]
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    last = np.cumsum(size)
    return Characters(flat, last - size, last, np.array(owner, np.int64), gram_hashes(flat), run_hashes(flat))


def _character_matches(c: Characters, items: Items, least: int) -> dict[tuple[int, int], list]:
    if not len(c.gram) or not len(items.gram):
        return {}
    low, high = np.searchsorted(items.gram, c.gram), np.searchsorted(items.gram, c.gram, side="right")
    p = np.flatnonzero(high > low)
    times = (high - low)[p]
    q = items.gram_at[np.repeat(low[p] - np.cumsum(times) + times, times) + np.arange(times.sum())]
    p = np.repeat(p, times)
    same = lambda a, b: c.flat[a] == items.code[b]
    sure = same(p, q)
    return _matches(p[sure], q[sure], lambda x: np.searchsorted(c.last, x, side="right"), c.owner, c.first, c.last, items, same, c.run, least)


def _find(df: DataFrame, blocks: list, words: int, chars: int, kind: str, item_kind: str) -> DataFrame:
    """``doc_id, item_id, longest, coverage, in_a_row`` of all tiled pairs; ``blocks`` are broadcast ``Items``."""
    tile_words, tile_chars = min(words, TILE_WORDS), min(chars, TILE_CHARACTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memories: list[dict[str, tuple[int, ...]]] = [{} for _ in blocks]
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                s = layout.read(part.column(1).to_pylist(), *(part.column(2 + k) for k in range(4)))
                edges = [*s.first.tolist(), len(s.lines)]
                texts, of = ([], []), ([], [])
                for n, (a, z) in enumerate(zip(edges, edges[1:])):
                    x = "\n".join(s.lines[a:z])
                    w = is_wide(x)
                    texts[w].append(x)
                    of[w].append(int(s.doc[n]))
                narrow, wide = words_of(texts[0], of[0]), characters_of(texts[1], of[1])
                docs, which, longest, covered, in_a_row = [], [], [], [], []
                for shared, memory in zip(blocks, memories):
                    items = shared.value
                    size = items.end - items.start
                    for least, tile, found in ((words, tile_words, _word_matches(narrow, items, tile_words, memory)), (chars, tile_chars, _character_matches(wide, items, tile_chars))):
                        for (n, j), ms in found.items():
                            chosen = tiles(ms, tile)
                            docs.append(n)
                            which.append(items.ids[j])
                            longest.append(chosen[0][0])
                            covered.append(sum(t[0] for t in chosen) / int(size[j]))
                            in_a_row.append(chosen[0][0] >= least)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(docs, pa.int64())), pa.array(which, item_type), pa.array(longest, pa.int32()), pa.array(covered, pa.float64()), pa.array(in_a_row, pa.bool_())],
                    ["doc_id", "item_id", "longest", "coverage", "in_a_row"],
                )

    item_type = pa.string() if item_kind == "string" else pa.int64()
    return df.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, longest int, coverage double, in_a_row boolean")


def leaked_items(
    docs: DataFrame, key: str, text: str, boxes: str, items: DataFrame, item_key: str, item_text: str, words: int = WORDS, chars: int = CHARACTERS, covered: float = COVERED
) -> DataFrame:
    """``doc_id, item_id, longest, coverage, in_a_row``: the pages into which an item leaked.

    ``longest`` is the longest tile in units, ``coverage`` the share of the item's units covered by
    tiles, wherever on the page they stand (passages that were moved about, and in other columns,
    too). A page is affected if a tile has ``words`` words or ``chars`` characters (``in_a_row``)
    or the coverage is at least ``covered``. Tiles don't cross columns; adverts within a column,
    line ends, broken words, punctuation and case don't interrupt them. Null and empty texts, and
    items shorter than a tile, match nothing. A page or an item that is sent repeatedly gives one
    row. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    item_kind = "string" if items.schema[item_key].dataType.simpleString() == "string" else "long"
    chosen = docs.filter(F.col(text) != "").select(F.col(key), F.col(text).alias("t_"), *(F.col(f"{boxes}.{c}").alias(f"{c}_") for c in ("x0", "y0", "x1", "y1")))
    share = docs.sparkSession.sparkContext.broadcast
    blocks, block, held = [], [], 0
    tile = min(words, TILE_WORDS), min(chars, TILE_CHARACTERS)
    rows = items.filter(F.col(item_text) != "").select(F.col(item_key).cast(item_kind), F.col(item_text)).dropna()
    for r in rows.orderBy(*rows.columns).toLocalIterator():
        block.append(tuple(r))
        held += len(r[1])
        if held > BLOCK_CHARACTERS:
            blocks.append(share(prepare(block, *tile)))
            block, held = [], 0
    if block or not blocks:
        blocks.append(share(prepare(block, *tile)))
    every = _find(chosen, blocks, words, chars, kind, item_kind)
    whole = every.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("coverage").alias("coverage"), F.max("in_a_row").alias("in_a_row"))
    return whole.filter(F.col("in_a_row") | (F.col("coverage") >= covered))
