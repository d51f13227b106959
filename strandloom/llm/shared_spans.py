"""Stretches that stand letter for letter in more than one record, by seed and extension.

Seeds are winnowed anchors: the smallest hashed word of every window, so that any ``least`` letters
that two records share hold an anchor of both. Each anchor carries the letters on its two sides,
as far as a stretch of ``least`` letters that holds it can reach. The seeds are joined on their
anchor, and each is extended to both sides as far as a seed of another record agrees: for every
number l of letters on the left the seeds that have the same l letters there and the rest of
``least`` on the right are a class, and a class of two records lets all its seeds reach so far.
That finds what extending all pairs would, in steps linear in the seeds, so a stretch in a third of
all records costs no more than its letters. What reaches further is found at the next anchors; the
extensions are merged to the longest spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.storage import materialise

#: Letters of a word in 64 bits.
SEED = 32
#: Letters of a record that are looked at together; longer records are cut into overlapping blocks.
LETTERS = 1 << 20
#: Seeds of one anchor that a task extends in memory; the classes of larger ones are formed by a shuffle.
MOST_SEEDS = 1 << 19
#: Positions of a record whose extensions are merged together.
TILE = 1 << 20

_U = np.uint64
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_SPACES = b" \t\n\r\x0b\x0c"


def letters(text: str | None) -> np.ndarray:
    """Codes 0-3 of A, C, G and T, 4 for anything else; white space is dropped."""
    raw = (text or "").encode("ascii", "replace").translate(None, _SPACES)
    return _CODE[np.frombuffer(raw, np.uint8)]


def words(code: np.ndarray, size: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The word of ``size`` letters (32 at most) at each position in 64 bits, the first letter highest, and whether it holds A, C, G and T only."""
    n = len(code) - size + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, bool)
    w, width = code.astype(_U) & _U(3), 1
    while width < size:
        step = min(width, size - width)  # overlapping halves give the same letters
        w = ((w[: len(w) - step] >> _U(2 * (width - step))) << _U(2 * width)) | w[step:] if step < width else (w[: len(w) - width] << _U(2 * width)) | w[width:]
        width += step
    bad = np.r_[0, np.cumsum(code == 4)]
    return w, bad[size:] == bad[:n]


def mixed(w: np.ndarray) -> np.ndarray:
    w = w ^ (w >> _U(33))
    w = w * _U(0xFF51AFD7ED558CCD)
    w = w ^ (w >> _U(33))
    w = w * _U(0xC4CEB9FE1A85EC53)
    return w ^ (w >> _U(33))


def seed_size(least: int) -> int:
    return min(SEED, max(1, least // 2))


def anchors(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, positions) of the winnowed anchors for shared stretches of ``least`` letters."""
    size = seed_size(least)
    w, ok = words(code, size)
    span = least - size + 1
    if len(w) < span:
        return w[:0], np.empty(0, np.int64)
    h = mixed(w)
    h[~ok] = _U(0xFFFFFFFFFFFFFFFF)
    # the smallest hash of each window, by doubling
    best, width = np.arange(len(h)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        width += step
    good = np.r_[0, np.cumsum(~ok)]
    whole = good[span:] == good[: len(best)]
    at = np.unique(best[whole])
    return w[at], at


def _sides(code: np.ndarray, at: np.ndarray, size: int, reach: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The letters right of each seed up to ``reach``, nearest first, 32 in a number, and how many there are."""
    bad = np.flatnonzero(np.r_[code == 4, True])
    stop = bad[np.searchsorted(bad, at + size)]
    n = np.minimum(stop - at - size, reach)
    padded = np.r_[code, np.full(reach + SEED + 1, 4, np.uint8)]
    w, _ = words(padded)
    out = []
    for k in range(-(-reach // SEED)):
        have = np.clip(n - k * SEED, 0, SEED)
        x = w[at + size + k * SEED]
        out.append(np.where(have == 0, _U(0), x & ~_below(have)))
    return out, n


def _below(have: np.ndarray) -> np.ndarray:
    """A mask of the bits behind the first ``have`` letters of a word."""
    return np.where(have >= SEED, _U(0), (_U(1) << (_U(2) * (_U(SEED) - np.clip(have, 1, SEED).astype(_U)))) - _U(1))


def seeds_of(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Anchors, their positions, the letters on the left and on the right, and their numbers."""
    size = seed_size(least)
    w, at = anchors(code, least)
    right, n_right = _sides(code, at, size, least - size)
    left, n_left = _sides(code[::-1], len(code) - at - size, size, least - size)
    return w, at, left, right, n_left, n_right


def _blocks(code: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long record in blocks: every window of ``least`` letters lies in one with all it can reach."""
    step = max(LETTERS, 4 * least)
    for a in range(0, max(len(code) - 2 * least, 1), step):
        low = max(0, a - 2 * least)
        yield low, code[low : a + step + 2 * least]


def _reach(side: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The first n letters of a side."""
    out = []
    for k, x in enumerate(side):
        have = min(max(n - k * SEED, 0), SEED)
        if have:
            out.append(x if have == SEED else x & ~_U((1 << 2 * (SEED - have)) - 1))
    return out


def extended(anchor: np.ndarray, rec: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], n_left: np.ndarray, n_right: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """How many letters left and right of each seed lie in a stretch that a seed of another record has too; -1 if none."""
    far_left, far_right = np.full(len(rec), -1), np.full(len(rec), -1)
    for l in range(reach + 1):
        r = reach - l
        who = np.flatnonzero((n_left >= l) & (n_right >= r))
        if len(who) < 2:
            continue
        cols = [anchor[who], *(x[who] for x in _reach(left, l)), *(x[who] for x in _reach(right, r))]
        order = np.lexsort((rec[who], *cols))
        fresh = np.zeros(len(who), bool)
        fresh[0] = True
        for c in cols:
            s = c[order]
            fresh[1:] |= s[1:] != s[:-1]
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(who)] - 1
        sorted_rec = rec[who][order]
        several = sorted_rec[first] != sorted_rec[last]
        hit = who[order][np.repeat(several, np.diff(np.r_[first, len(who)]))]
        far_left[hit] = np.maximum(far_left[hit], l)
        far_right[hit] = np.maximum(far_right[hit], r)
    return far_left, far_right


def _names(least: int) -> tuple[list[str], str]:
    k = -(-(least - seed_size(least)) // SEED)
    names = ["anchor", "rec_key", "at", "n_left", "n_right", *(f"left{i}" for i in range(k)), *(f"right{i}" for i in range(k))]
    return names, ", ".join(f"{n} {'short' if n.startswith('n_') else 'long'}" for n in names)


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _settled(c: list[np.ndarray], reach: int) -> list[np.ndarray]:
    """Seeds of a task of which two records have the same letters all around are settled.

    Of each such group two records stay seeds for others to be compared with; the rest are marked by
    -1 letters and get an anchor of their own, so that they spread over the tasks.
    """
    h = mixed(c[0].view(_U))
    for x in c[5:]:
        h = mixed(h ^ x.view(_U))
    order = np.argsort(h, kind="stable")
    order = order[(c[3][order] == reach) & (c[4][order] == reach)]
    if len(order) < 3:
        return c
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for x in (c[0], *c[5:]):
        s = x[order]
        fresh[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(fresh)
    size = np.diff(np.r_[first, len(order)])
    rec = c[1][order]
    low, high = (np.repeat(f.reduceat(rec, first), size) for f in (np.minimum, np.maximum))
    done = order[(rec != low) & (rec != high)]
    if len(done):
        c = [x.copy() for x in c]
        c[0][done] = mixed((c[1][done] * 1_000_003 + c[2][done]).view(_U)).view(np.int64)
        c[3][done] = -1
        for x in c[4:]:
            x[done] = 0
    return c


def _extensions(least: int, most: int):
    """Over seeds sorted by anchor: ``rec_key, start_at, end_at`` of each extension, and the seeds of anchors with more than ``most`` as they are."""
    size = seed_size(least)
    reach = least - size
    names, _ = _names(least)
    k = (len(names) - 5) // 2

    def out(rec, start, end, rows=None) -> pa.RecordBatch:
        n = len(rec) if rows is None else len(rows[0])
        null = lambda t: pa.nulls(n, t)
        found = [pa.array(x) if rows is None else null(pa.int64()) for x in (rec, start, end)]
        crowd = [null(pa.int16() if c.startswith("n_") else pa.int64()) if rows is None else pa.array(rows[i]) for i, c in enumerate(names)]
        return pa.RecordBatch.from_arrays([*found, *crowd], ["span_rec", "start_at", "end_at", *names])

    def solve(c: list[np.ndarray]) -> pa.RecordBatch | None:
        done = c[3] < 0
        settled = [x[done] for x in c[1:3]]
        c = [x[~done] for x in c]
        found = [(settled[0], settled[1] - reach, settled[1] + size + reach), *([part] if len(c[0]) and (part := among(c)) else [])]
        whole = [np.concatenate(x) for x in zip(*found)]
        return out(*whole) if len(whole[0]) else None

    def among(c: list[np.ndarray]) -> tuple | None:
        first = np.flatnonzero(np.r_[True, c[0][1:] != c[0][:-1]])
        low, high = np.minimum.reduceat(c[1], first), np.maximum.reduceat(c[1], first)
        keep = np.repeat(low != high, np.diff(np.r_[first, len(c[0])]))
        if not keep.any():
            return None
        c = [x[keep] for x in c]
        sides = [[x.view(_U) for x in c[5 + i * k : 5 + (i + 1) * k]] for i in (0, 1)]
        l, r = extended(c[0], c[1], *sides, c[3], c[4], reach)
        hit = l >= 0
        return c[1][hit], (c[2] - l)[hit], (c[2] + size + r)[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n, crowd = 0, None  # the anchor whose seeds are passed on
        for b in batches:
            if not b.num_rows:
                continue
            c = _arrays(b)
            if crowd is not None:
                own = int(np.searchsorted(c[0], crowd, side="right"))
                if own:
                    yield out(None, None, None, [x[:own] for x in c])
                    c = [x[own:] for x in c]
                if not len(c[0]):
                    continue
                crowd = None
            held.append(c)
            n += len(c[0])
            if n <= max(most, 50_000):
                continue
            c = [np.concatenate(x) for x in zip(*held)]
            whole = int(np.searchsorted(c[0], c[0][-1]))  # the last anchor may go on
            if whole and (found := solve([x[:whole] for x in c])) is not None:
                yield found
            held, n = [[x[whole:] for x in c]], n - whole
            if n > most:
                crowd = c[0][-1]
                yield out(None, None, None, held[0])
                held, n = [], 0
        if n and (found := solve([np.concatenate(x) for x in zip(*held)])) is not None:
            yield found

    return run


def _crowded(seeds: DataFrame, least: int) -> DataFrame:
    """The extensions of anchors with very many seeds: each class (l letters on the left, the rest on the right) is a group, spread over all tasks and combined before the shuffle."""
    size = seed_size(least)
    reach = least - size

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _arrays(b)
            k = (len(c) - 5) // 2
            for l in range(reach + 1):
                who = np.flatnonzero((c[3] >= l) & (c[4] >= reach - l))
                sides = [*_reach([x.view(_U) for x in c[5 : 5 + k]], l), *_reach([x.view(_U) for x in c[5 + k :]], reach - l)]
                # all letters of the class, so that it is exact
                key = np.ascontiguousarray(np.stack([c[0].view(_U), *sides], axis=1)[who])
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(key.shape[1] * 8), len(who), [None, pa.py_buffer(key)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(who), l, np.int16)), pa.array(c[1][who]), pa.array(c[2][who])], ["class", "l", "rec_key", "at"])

    rows = seeds.mapInArrow(classes, "class binary, l short, rec_key long, at long")
    several = rows.groupBy("class", "l").agg(F.min("rec_key").alias("a"), F.max("rec_key").alias("b")).filter("a <> b").select("class", "l")
    hit = rows.join(several, ["class", "l"], "left_semi").groupBy("rec_key", "at").agg(F.max("l").alias("far"), F.min("l").alias("near"))
    return hit.select("rec_key", (F.col("at") - F.col("far")).alias("start_at"), (F.col("at") + size + reach - F.col("near")).alias("end_at"))


def extensions(df: DataFrame, key: str, seq: str, least: int = 64) -> DataFrame:
    """``rec_key, start_at, end_at``: stretches that another record has too; each shared letter lies in one."""
    if least < 2:
        raise ValueError("a shared stretch has at least 2 letters")
    source = df.select(F.col(key).cast("long").alias("rec_key"), F.col(seq).alias("seq")).dropna()
    names, schema = _names(least)
    kinds = [pa.int16() if n.startswith("n_") else pa.int64() for n in names]
    reach = least - seed_size(least)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full() -> pa.RecordBatch:
            c = _settled([np.concatenate(x).astype(np.int16 if t == pa.int16() else np.int64) for x, t in zip(zip(*parts), kinds)], reach)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in c], names)

        parts: list[list[np.ndarray]] = []
        pieces: list[tuple[int, int, np.ndarray]] = []

        def read() -> int:
            """The seeds of the pieces that wait, all in one pass: a letter that is none stands between them."""
            size = np.array([len(code) + 1 for *_, code in pieces])
            begin = np.cumsum(size) - size
            w, at, left, right, n_left, n_right = seeds_of(np.concatenate([np.r_[code, np.uint8(4)] for *_, code in pieces]), least)
            of = np.searchsorted(begin, at, side="right") - 1
            keys, low = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
            parts.append([w.view(np.int64), keys[of], at - begin[of] + low[of], n_left, n_right, *(x.view(np.int64) for x in (*left, *right))])
            pieces.clear()
            return len(w)

        letters_held, held = 0, 0
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1)):
                for low, code in _blocks(letters(s.as_py()), least):
                    if len(code) < least:
                        continue
                    pieces.append((k, low, code))
                    letters_held += len(code)
                    if letters_held > LETTERS >> 2:
                        held, letters_held = held + read(), 0
                    if held > 200_000:
                        yield full()
                        parts.clear()
                        held = 0
        if pieces:
            read()
        if parts:
            yield full()

    found = source.mapInArrow(seeds, schema).repartition("anchor").sortWithinPartitions("anchor")
    done = materialise(found.mapInArrow(_extensions(least, MOST_SEEDS), f"span_rec long, start_at long, end_at long, {schema}"), "extensions")
    few = done.filter("span_rec is not null").select(F.col("span_rec").alias("rec_key"), "start_at", "end_at")
    return few.unionByName(_crowded(done.filter("span_rec is null").select(*names), least)).distinct()


def _merged(spans: DataFrame, by: list[str], keep: Column | None = None) -> DataFrame:
    """Overlapping and touching spans of each group made one."""
    w = Window.partitionBy(*by).orderBy("start_at", "end_at")
    before = F.max("end_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start_at") > before, F.lit(True)).cast("int")
    numbered = spans.withColumn("new", new).withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "no").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at")).drop("no")


def shared_spans(df: DataFrame, key: str, seq: str, least: int = 64) -> DataFrame:
    """``rec_key, start_at, end_at``: the longest spans made of overlapping or touching shared stretches of ``least`` letters or more.

    Positions are 0-based, half-open and don't count white space; letter case doesn't matter, and
    letters other than A, C, G and T end a stretch. Rows with a null key or sequence, and sequences
    shorter than ``least``, have no spans; rows with equal keys are one record, so a record that is
    only sent again shares nothing. Other columns are ignored.

    Extensions are merged within tiles of a record first. Only what touches the edges of its tile
    is looked at again by record.
    """
    tiled = _merged(extensions(df, key, seq, least).withColumn("tile", F.expr(f"start_at div {TILE}")), ["rec_key", "tile"])
    begin = F.col("tile") * TILE
    # an extension is shorter than 2 * least, so one from the tile before reaches no further
    edge = (F.col("end_at") >= begin + TILE) | (F.col("start_at") < begin + 2 * least)
    across = _merged(tiled.filter(edge).select("rec_key", "start_at", "end_at"), ["rec_key"])
    return across.unionByName(tiled.filter(~edge).select("rec_key", "start_at", "end_at"))


def shared_share(df: DataFrame, key: str, seq: str, spans: DataFrame) -> DataFrame:
    """For each record ``rec_key, n_bases, n_shared``: how many of its bases stand elsewhere too."""
    size = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("rec_key")).agg(F.max(F.length(F.regexp_replace(F.coalesce(F.col(seq), F.lit("")), r"\s", ""))).cast("long").alias("n_bases"))
    shared = spans.groupBy("rec_key").agg(F.sum(F.col("end_at") - F.col("start_at")).alias("n_shared"))
    return size.join(shared, "rec_key", "left").select("rec_key", "n_bases", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
