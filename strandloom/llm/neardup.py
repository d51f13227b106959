"""Near-duplicate sequences: SuperMinHash signatures, banding, verification, grouping.

Exact copies are reduced to classes first, so they cost one signature. SuperMinHash gives every
element its own permutation of the registers; element x writes j + r(x, j) into the register at
place j of its permutation, and a record is done as soon as all its registers hold a value below
the next j. The ranks are computed once for each distinct element of a batch and all records of
the batch advance one j at a time, so the early stop is a shrinking set of records.

Words that very many records share (adapters) would fill a few buckets with unrelated records. They
are counted over all data and left out of the signature, never out of the similarity. Leaving them
out lowers the similarity that the signature sees: of a pair at the threshold s, one of whose
records has the share c of common words, it is still (s - c) / (1 - c) at least, so a record gets as
many bands as that takes. Bands are nested, so two records meet on those of the smaller share.
Records with so large a share that this is no use get a signature of all their words besides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import components as cc
from strandloom.storage import materialise

WORD = 8
ROWS = 3
#: The least chance of a pair at the threshold to share a bucket; it sets the number of bands.
CHANCE = 0.965
#: A word is common if it stands in at least this share of the classes.
COMMON = 0.01
#: From this share of common words on, in parts of the threshold, a record gets a signature of all its words too.
FULL = 0.6
#: Rows of a bucket are compared with the bucket's first and with the preceding ones as they stream by; that is
#: all pairs in buckets up to PRECEDING + 1 rows. The other pairs of larger buckets are formed block by block.
FIRST, PRECEDING, BLOCK = 8, 40, 64

_U = np.uint64


def oriented(seq: Column, reverse: Column) -> Column:
    """Upper-case letters without white space, reverse-complemented where ``reverse``."""
    s = F.upper(F.regexp_replace(seq, r"\s+", ""))
    return F.when(reverse, F.reverse(F.translate(s, "ACGT", "TGCA"))).otherwise(s)


def coded(df: DataFrame, key: str, text: str) -> DataFrame:
    """``rec_key, text, h1, h2``: texts are told apart by two 64-bit hashes together."""
    t = F.col("text")
    kept = df.select(F.col(key).cast("long").alias("rec_key"), F.col(text).alias("text")).filter(F.col("rec_key").isNotNull() & t.isNotNull() & ~t.isin("", "*"))
    return kept.select("rec_key", "text", F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def ranks(elements: np.ndarray, registers: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For j < depth: the register at place j of each element's permutation, and r(x, j) in 24 bits."""
    n = len(elements)
    perm = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.int32), (n, 1))
    r = np.empty((n, depth), np.uint32)
    at = np.arange(n)
    for j in range(depth):
        draw = mixed(elements + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r[:, j] = draw >> _U(40)
        k = j + ((draw & _U(0xFFFFFFFF)) * _U(registers - j) >> _U(32)).astype(np.int64)
        held = perm[at, j].copy()
        perm[at, j] = perm[at, k]
        perm[at, k] = held
    return perm[:, :depth], r


#: Ranks of all words of A, C, G and T are kept by each worker up to this depth.
DEPTH = 12
_ALPHABET = b"ACTG"


def small_code(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 16-bit code for the words of A, C, G and T, and which words are such."""
    x = (words >> _U(1)) & _U(0x0303030303030303)  # A, C, T, G are 0, 1, 2, 3
    y = (x | (x >> _U(6))) & _U(0x000F000F000F000F)
    y = (y | (y >> _U(12))) & _U(0x000000FF000000FF)
    y = (y | (y >> _U(24))) & _U(0xFFFF)
    # the letter that has the code, in each byte at once: A 41, C 43, G 47, T 54
    low, high = x & _U(0x0101010101010101), (x >> _U(1)) & _U(0x0101010101010101)
    back = _U(0x4141414141414141) + low * _U(2) + high * _U(0x13) - (low & high) * _U(0x0F)
    return y.astype(np.int64), back == words


def bands_for(threshold: float, share: np.ndarray | float) -> np.ndarray:
    """How many bands a record with this share of common words needs (see above)."""
    c = np.minimum(share, FULL * threshold)
    seen = (threshold - c) / (1 - c)
    return np.ceil(np.log(1 - CHANCE) / np.log1p(-np.minimum(seen, 1 - 1e-9) ** ROWS)).astype(np.int64)


def _seeded(words: np.ndarray, block: int) -> np.ndarray:
    """Other elements for each block, so that the blocks' registers are independent."""
    return mixed(words + _U(block * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) if block else words


@cache
def _usual_ranks(registers: int, block: int = 0) -> tuple[np.ndarray, np.ndarray]:
    letters = np.frombuffer(_ALPHABET, np.uint8).astype(_U)
    codes = np.arange(1 << 2 * WORD, dtype=_U)
    words = np.zeros(len(codes), _U)
    for i in range(WORD):
        words |= letters[((codes >> _U(2 * i)) & _U(3)).astype(np.int64)] << _U(8 * i)
    perm, r = ranks(_seeded(words, block), registers, min(DEPTH, registers))
    return np.ascontiguousarray(perm), r


def signatures(words: np.ndarray, record: np.ndarray, n_records: int, registers: int, step: int = 24, block: int = 0, coded: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """SuperMinHash registers of each record from its words (``record`` ascending); each value holds j and r.

    Signatures of different ``block`` are independent of each other. ``coded`` is the words' ``small_code`` if it is known.
    """
    empty = np.uint32(0xFFFFFFFF)
    sig = np.full(n_records * registers, empty, np.uint32)
    record = record.astype(np.int64)
    code, usual = coded or small_code(words)
    perm, r = _usual_ranks(registers, block)
    if not usual.all():
        known, other = np.unique(words[~usual], return_inverse=True)
        code = code.copy()
        code[~usual] = other + len(r)
        more = ranks(_seeded(known, block), registers, min(DEPTH, registers))
        perm, r = np.concatenate([perm, more[0]]), np.concatenate([r, more[1]])
    at, depth = 0, min(DEPTH, registers)
    while at < registers and len(code):
        if at:  # few records are left: only their words go on
            depth = min(registers, at + step)
            known, code = np.unique(words, return_inverse=True)
            perm, r = ranks(_seeded(known, block), registers, depth)
        for j in range(at, depth):
            place = record * registers + np.ascontiguousarray(perm[:, j])[code]
            # a register written at an earlier place holds less
            free = np.flatnonzero(sig[place] == empty) if j else slice(None)
            np.minimum.at(sig, place[free], np.ascontiguousarray(r[:, j])[code[free]] | np.uint32(j << 24))
            open_ = (sig.reshape(n_records, registers) == empty).any(axis=1)
            live = np.flatnonzero(open_[record])
            # words of full records change nothing; leaving them out each time would cost more than it saves
            if len(live) <= 0.7 * len(code) or j == depth - 1:
                record, code, words = record[live], code[live], words[live]
            if not len(live):
                code = live
                break
        at = depth
        step *= 2
    return sig.reshape(n_records, registers)


def band_keys(sig: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit key for each band of each record."""
    n, m = sig.shape
    grouped = sig.reshape(n, m // ROWS, ROWS).astype(_U)
    key = np.full((n, m // ROWS), _U(salt * 1_000_003), _U) + np.arange(m // ROWS, dtype=_U)
    for i in range(ROWS):
        key = mixed(key ^ grouped[:, :, i]) + _U(0x9E3779B97F4A7C15)
    return key


def _words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All 8-letter words of a batch packed in 64 bits, their records, and each record's number of words."""
    texts = texts.cast(pa.large_binary()) if isinstance(texts, pa.Array) else texts
    buf = texts.buffers()
    off = np.frombuffer(buf[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buf[2], np.uint8)[off[0] : off[-1]] if buf[2] is not None else np.empty(0, np.uint8)
    off = off - off[0]
    count = np.maximum(np.diff(off) - WORD + 1, 0)
    if not count.sum():
        return np.empty(0, _U), np.empty(0, np.int64), count
    packed = np.ndarray((len(raw) - WORD + 1,), "<u8", raw.tobytes(), strides=(1,))
    record = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    place = off[:-1][record] + np.arange(count.sum()) - first[record]
    return packed[place], record, count


#: Letters of a slice of a batch: bounds the memory of its words, however long the texts are.
LETTERS = 4_000_000


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows and ``LETTERS`` letters at most; a longer text is a slice of its own."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LETTERS, side="right"))
            end = max(at + 1, min(at + rows, fits))
            yield b.slice(at, end - at)
            at = end


def _counted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and how often they occur."""
    code, usual = small_code(words)
    n = np.bincount(code[usual], minlength=1 << 2 * WORD)
    there = np.flatnonzero(n)
    letters = np.frombuffer(_ALPHABET, np.uint8).astype(_U)
    w = np.zeros(len(there), _U)
    for i in range(WORD):
        w |= letters[(there >> 2 * i) & 3] << _U(8 * i)
    others, m = np.unique(words[~usual], return_counts=True)
    return np.r_[w, others], np.r_[n[there], m]


def common_words(texts: DataFrame, share: float = COMMON) -> tuple[DataFrame, int]:
    """``word``: the packed words that occur ``share`` times the number of rows or more, all rows counted; and that number.

    Each task adds up its own rows first, so at most one row per distinct word leaves it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, rows = np.empty(0, _U), np.empty(0, np.int64), 0
        for b in _slices(batches, 20_000):
            w, c = _counted(_words_of(b.column(0))[0])
            both, at = np.unique(np.r_[words, w], return_inverse=True)
            n = np.bincount(at, np.r_[n, c], len(both)).astype(np.int64)
            words, rows = both, rows + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[words.view(np.int64), 0]), pa.array(np.r_[n, rows]), pa.array(np.r_[np.zeros(len(words), bool), True])], ["word", "n", "whole"])

    counted = texts.mapInArrow(count, "word long, n long, whole boolean").groupBy("whole", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "words")
    total = counted.filter("whole").agg(F.sum("n")).first()[0] or 0
    return counted.filter("not whole").filter(F.col("n") >= max(share * total, 2)).select("word"), total


#: Bucket rows that a task gathers before it passes them on, those of a range of buckets on average at most, and those
#: of one row of the shuffle at most.
GATHERED, RANGE, PACKED = 1 << 20, 1 << 17, 128


def _gathered(rows: Iterator[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """``range, slots, rests``: slots and rests packed by the buckets' upper ``bits``, copies within a gathering left out."""
    held, n = [], 0

    def packed() -> pa.RecordBatch:
        slot, rest = (np.concatenate(x) for x in zip(*held))
        slot, rest = _in_order(slot, rest)
        of = (slot.view(_U) >> _U(64 - bits)).astype(np.int32)
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        size = np.diff(np.r_[first, len(of)])
        pieces = -(-size // PACKED)
        first = np.repeat(first, pieces) + PACKED * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        off = np.r_[first, len(of)].astype(np.int32)
        blobs = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(off * np.int32(x.itemsize)), pa.py_buffer(np.ascontiguousarray(x))]) for x in (slot, rest)]
        return pa.RecordBatch.from_arrays([pa.array(of[first]), *blobs], ["range", "slots", "rests"])

    for slot, rest in rows:
        # a long text has many bands: the gathering is passed on before it grows beyond its size
        for i in range(0, len(slot), GATHERED):
            part = slot[i : i + GATHERED], rest[i : i + GATHERED]
            if n and n + len(part[0]) > GATHERED:
                yield packed()
                held, n = [], 0
            held.append(part)
            n += len(part[0])
    if n:
        yield packed()


def _in_order(slot: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by slot, copies that stand together left out."""
    order = np.argsort(slot)
    slot, rest = slot[order], rest[order]
    fresh = np.r_[True, (slot[1:] != slot[:-1]) | (rest[1:] != rest[:-1])][: len(slot)]
    return slot[fresh], rest[fresh]


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's begin and end."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind), (off - off[0]) // np.dtype(kind).itemsize


def _shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``slot, rest`` in order, from packed rows sorted by range: only of buckets that have several rows.

    One range is held at a time; when it grows its copies are left out.
    """
    slots, rests, n, most, at = [], [], 0, GATHERED, None

    def settled() -> Iterator[pa.RecordBatch]:
        slot, rest = _in_order(np.concatenate(slots), np.concatenate(rests))
        bucket = slot >> 16
        same = bucket[1:] == bucket[:-1]
        several = np.r_[same, False] | np.r_[False, same]
        slot, rest = slot[several], rest[several]
        for i in range(0, len(slot), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(slot[i : i + 10_000]), pa.array(rest[i : i + 10_000])], ["slot", "rest"])

    for b in batches:
        if not b.num_rows:
            continue
        of = b.column(0).to_numpy()
        (slot, off), (rest, _) = _unpacked(b.column(1), np.int64), _unpacked(b.column(2), np.int32)
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for x, y in zip(first.tolist(), [*first[1:].tolist(), len(of)]):
            if n and of[x] != at:
                yield from settled()
                slots, rests, n = [], [], 0
            at = of[x]
            # copied, so that a batch isn't kept for the rows of its last range
            slots.append(slot[off[x] : off[y]].copy())
            rests.append(rest[off[x] : off[y]].copy())
            n += int(off[y] - off[x])
            if n > most:
                one = _in_order(np.concatenate(slots), np.concatenate(rests))
                slots, rests, n = [one[0]], [one[1]], len(one[0])
                most = max(most, 2 * n)
    if n:
        yield from settled()


def bucket_rows(texts: DataFrame, common: np.ndarray, total: int, threshold: float = 0.5) -> DataFrame:
    """``range, slots, rests``: a slot and a rest for every band of every text of ``ident, text``, of which there are ``total``.

    A bucket has 48 bits and an ident 40; a slot is the bucket and the ident's upper 16 bits,
    a rest its lower 24. Chance collisions of either only cost a comparison. Rows whose buckets are in
    one range are packed together, so that few rows go through the shuffle and are sorted there; a
    range is sorted by the task that reads it.

    Bands come in blocks of as many as a record without common words needs, each block with
    registers of its own; a record takes the first bands it needs of as many blocks.
    """
    frozen = np.sort(common.view(_U))
    base = int(bands_for(threshold, 0.0))
    # texts have somewhat more bands than base
    bits = max(1, min(30, int(np.ceil(np.log2(max(1, total * 2 * base / RANGE))))))
    frozen_code, frozen_usual = small_code(frozen)
    is_rare = np.ones(1 << 2 * WORD, bool)
    is_rare[frozen_code[frozen_usual]] = False

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in _slices(batches, 4000):
            ids = b.column(0).to_numpy()
            words, record, count = _words_of(b.column(1))
            code, usual = small_code(words)
            rare = is_rare[code]
            if not usual.all():
                rare[~usual] = ~np.isin(words[~usual], frozen)
            left = np.bincount(record[rare], minlength=len(ids))
            share = 1 - left / np.maximum(count, 1)
            need = np.where(left > 0, bands_for(threshold, share), 0)
            full = (count > 0) & (share >= FULL * threshold)
            keys, owners = [], []

            def sign(salt: int, block: int, who: np.ndarray, keep: np.ndarray, most: np.ndarray) -> None:
                sel = keep & who[record]
                if not sel.any():
                    return
                rank = np.cumsum(who) - 1
                k = band_keys(signatures(words[sel], rank[record[sel]], int(who.sum()), ROWS * base, block=block, coded=(code[sel], usual[sel])), salt)
                wanted = np.arange(base) < most[who][:, None]
                keys.append(k[wanted])
                owners.append(np.repeat(ids[who], wanted.sum(axis=1)))

            for block in range(-(-int(need.max(initial=0)) // base)):
                sign(1 + 2 * block, block, need > block * base, rare, need - block * base)
            sign(2, 0, full, np.ones(len(words), bool), np.full(len(ids), base))
            if keys:
                k, who = np.concatenate(keys), np.concatenate(owners)
                slot = (k >> _U(16) << _U(16)).view(np.int64) | (who >> 24)
                yield slot, (who & 0xFFFFFF).astype(np.int32)

    return texts.mapInArrow(lambda batches: _gathered(rows(batches), bits), "range int, slots binary, rests binary")


def _rows(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A pair (rank -1), or a bucket, an ident and its rank for the rows beyond a bucket's first ones."""
    return pa.RecordBatch.from_arrays([pa.array(rank.astype(np.int64)), pa.array(a), pa.array(b)], ["rank", "a", "b"])


def _pairs_between_blocks(rows: DataFrame) -> DataFrame:
    """``a, b``: the pairs of large buckets that lie too far apart to meet in the stream.

    A bucket's rows are cut into blocks and every two blocks are a group of their own, so that no
    task holds a bucket. Buckets of that size hold families of near copies (words that unrelated
    records share aren't in the signatures), so the pairs are mostly links.
    """
    crowd = rows.filter("rank >= 0").select(F.col("a").alias("bucket"), F.col("b").alias("ident"), "rank")
    large = crowd.groupBy("bucket").agg(F.max("rank").alias("most")).filter(F.col("most") > PRECEDING)
    placed = crowd.join(large, "bucket").withColumn("block", F.expr(f"rank div {BLOCK}"))
    last = F.expr(f"most div {BLOCK}")
    low = placed.select("bucket", F.col("block").alias("lo"), F.explode(F.sequence("block", last)).alias("hi"), F.col("ident").alias("x"), F.col("rank").alias("i"))
    high = placed.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("lo"), F.col("block").alias("hi"), F.col("ident").alias("y"), F.col("rank").alias("j"))
    far = low.join(high, ["bucket", "lo", "hi"]).filter((F.col("j") - F.col("i") > PRECEDING) & (F.col("x") != F.col("y")))
    return far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _pairs_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and the ids' upper bits (one number sorts faster than two), so copies
    stand together but for ids that differ in their lower bits only; a bucket may run on over batches, of which only a few rows are kept."""
    key = np.empty(0, np.int64)
    ids, rank = key, key
    for b in batches:
        if not b.num_rows:
            continue
        slot = b.column(0).to_numpy()
        k, i = slot >> 16, (slot & 0xFFFF) << 24 | b.column(1).to_numpy()
        copy = np.r_[False, (k[1:] == k[:-1]) & (i[1:] == i[:-1])]
        if len(key):
            copy[0] = k[0] == key[-1] and i[0] == ids[-1]
        k, i = k[~copy], i[~copy]
        if not len(k):
            continue
        new = len(key)
        k, i = np.r_[key, k], np.r_[ids, i]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[start, len(k)])
        r = np.arange(len(k)) - np.repeat(start, size)
        if new:  # the carried bucket goes on with the ranks it had
            rank_of_last = rank[-1]
            own = (np.arange(len(k)) >= new) & (k == key[-1])
            r[:new] = rank
            r[own] = rank_of_last + 1 + np.arange(own.sum())
        left, right = [], []
        for back in range(1, PRECEDING + 1):
            same = np.flatnonzero((k[back:] == k[:-back]) & (np.arange(back, len(k)) >= new) & (r[back:] - r[:-back] == back))
            if not len(same):
                break
            left.append(i[same])
            right.append(i[same + back])
        long = np.flatnonzero((r > PRECEDING) & (np.arange(len(k)) >= new))
        if len(long):
            firsts = {}
            for p in np.flatnonzero(r < FIRST):
                firsts.setdefault(k[p], []).append(i[p])
            for bucket in np.unique(k[long]):
                later = i[long[k[long] == bucket]]
                for f in firsts.get(bucket, []):
                    left.append(np.full(len(later), f))
                    right.append(later)
        if left:
            a, c = np.concatenate(left), np.concatenate(right)
            a, c = np.minimum(a, c), np.maximum(a, c)
            ok = a < c
            yield _rows(np.full(int(ok.sum()), -1), a[ok], c[ok])
        crowd = np.flatnonzero((r >= FIRST) & (np.arange(len(k)) >= new))
        if len(crowd):
            yield _rows(r[crowd], k[crowd], i[crowd])
        last = k == k[-1]
        held = last & ((r < FIRST) | (r > r[-1] - PRECEDING))
        key, ids, rank = k[held], i[held], r[held]


def _distinct(pair: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Sorted distinct (pair, word) codes in 32 bits; a batch has fewer than 2^16 pairs."""
    k = np.sort((pair.astype(np.uint32) << np.uint32(16)) | code.astype(np.uint32))
    return k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Shared distinct words over all distinct words of each pair of texts, at most 2^16 pairs."""
    n = len(a)
    both, size, odd = [], np.zeros(n), np.zeros(n, bool)
    for texts in (a, b):
        words, pair, _ = _words_of(texts)
        code, usual = small_code(words)
        odd[pair[~usual]] = True
        k = _distinct(pair[usual], code[usual])
        both.append(k)
        size += np.bincount(k >> np.uint32(16), minlength=n)
    k = np.sort(np.concatenate(both))
    shared = np.bincount(k[1:][k[1:] == k[:-1]] >> np.uint32(16), minlength=n) if len(k) else np.zeros(n)
    out = shared / np.maximum(size - shared, 1)
    # words with other letters have no 16-bit code: those pairs are compared by their texts
    for i in np.flatnonzero(odd).tolist():
        x, y = (({t[j : j + WORD] for j in range(len(t) - WORD + 1)}) for t in (a[i].as_py(), b[i].as_py()))
        out[i] = len(x & y) / max(1, len(x | y))
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 20_000):
            sims = similarities(b.column(0), b.column(1))
            ok = pa.array(sims >= threshold)
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(ok) for i in range(2, 6)), pa.array(sims).filter(ok)], ["h1_a", "h2_a", "h1_b", "h2_b", "similarity"])

    return run


def similar_texts(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``h1_a, h2_a, h1_b, h2_b, similarity`` of the different texts of ``coded`` rows at or above the threshold.

    Similarity is that of the sets of 8-letter words; texts shorter than that have none and belong
    to no pair.
    """
    ident = F.col("h1").bitwiseAND(F.lit((1 << 40) - 1))
    texts = rows.filter(F.length("text") >= WORD).select(ident.alias("ident"), "text", "h1", "h2")
    # at most 1 / COMMON times the words of a record: bounded whatever the data
    common, total = common_words(texts.select("text"))
    frozen = np.array([r.word for r in common.collect()], np.int64)
    buckets = bucket_rows(texts.select("ident", "text"), frozen, total, threshold)
    placed = buckets.repartition("range").sortWithinPartitions("range")
    met = materialise(placed.mapInArrow(lambda b: _pairs_in_buckets(_shared_buckets(b)), "rank long, a long, b long").distinct(), "met")
    pairs = met.filter("rank = -1").select("a", "b").unionByName(_pairs_between_blocks(met))
    pairs = materialise(pairs.distinct(), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("ident")).distinct()
    seqs = texts.join(needed, "ident", "left_semi").groupBy("ident", "h1", "h2").agg(F.min("text").alias("text"))
    seqs = materialise(seqs, "needed")
    sides = [seqs.select(F.col("ident").alias(x), F.col("text").alias(f"text_{x}"), F.col("h1").alias(f"h1_{x}"), F.col("h2").alias(f"h2_{x}")) for x in "ab"]
    full = pairs.join(sides[0], "a").join(sides[1], "b").select("text_a", "text_b", "h1_a", "h2_a", "h1_b", "h2_b")
    return full.mapInArrow(_verify(threshold), "h1_a long, h2_a long, h1_b long, h2_b long, similarity double")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``rec_key, class_id`` of every record with a text, and ``a, b, similarity``
    between the classes of different texts. Records with equal texts are a class, named by its
    smallest key.

    ``key`` may repeat (a record sent again); a key with several different texts belongs to several
    classes. Null, empty and ``*`` texts and null keys are left out; texts shorter than one word are
    members without links. Other columns are ignored. An empty table gives two empty tables.
    """
    # written once: four passes read it, and forming the texts costs more than reading them
    rows = materialise(coded(df, key, text), "coded")
    known = rows.select("rec_key", "h1", "h2").distinct()
    least = known.groupBy("h1", "h2").agg(F.min("rec_key").alias("class_id"))
    members = materialise(known.join(least, ["h1", "h2"]), "members")
    names = members.filter("rec_key = class_id").select("h1", "h2", "class_id")
    found = similar_texts(rows, threshold)
    a, b = (names.select(F.col("h1").alias(f"h1_{x}"), F.col("h2").alias(f"h2_{x}"), F.col("class_id").alias(x)) for x in "ab")
    links = found.join(a, ["h1_a", "h2_a"]).join(b, ["h1_b", "h2_b"])
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return members.select("rec_key", "class_id"), materialise(links, "verified")


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id_a, id_b``: every pair of different records of one class or of linked classes, smaller id first."""
    a = members.select(F.col("rec_key").alias("x"), F.col("class_id").alias("a"))
    b = members.select(F.col("rec_key").alias("y"), F.col("class_id").alias("b"))
    copied = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    both = links.select("a", "b").unionByName(copied).join(a, "a").join(b, "b").filter("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``rec_key, class_id, group_id, n_links``: one row per member; links are those of its class."""
    joined = cc.components(links, "a", "b").withColumnsRenamed({"node": "class_id", "component": "group_id"})
    n = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(joined, "class_id", "left").join(n, "class_id", "left").select(
        "rec_key", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
