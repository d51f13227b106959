import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import components, neardup
from tests.conftest import rows


def words(s):
    return {s[i : i + 8] for i in range(len(s) - 7)}


def similarity(s, t):
    return len(words(s) & words(t)) / max(1, len(words(s) | words(t)))


def plain_superminhash(elements, m):
    """The algorithm step by step, one element after another."""
    perm, r = neardup.ranks(np.array(elements, np.uint64), m, m)
    sig = [None] * m
    for e in range(len(elements)):
        for j in range(m):
            p, v = int(perm[e, j]), (j << 24) | int(r[e, j])
            if sig[p] is None or v < sig[p]:
                sig[p] = v
    return sig


def test_ranks_are_permutations():
    perm, _ = neardup.ranks(np.arange(50, dtype=np.uint64), 72, 72)
    assert all(sorted(p) == list(range(72)) for p in perm.tolist())


@pytest.mark.parametrize("sizes", [[1, 2, 7], [300, 5, 72], [40]])
def test_signatures_with_early_stop(sizes):
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in sizes]
    got = neardup.signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), 24)
    for s, g in zip(sets, got):
        assert g.tolist() == plain_superminhash(s, 24)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 150).astype(np.uint64)
        a, b = base[:110], base[40:]
        sig = neardup.signatures(np.r_[a, b], np.repeat([0, 1], 110), 2, 72)
        errors.append((sig[0] == sig[1]).mean() - 70 / 150)
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.25 / 72


def test_bucket_pairs_match_brute_force():
    rng = random.Random(2)
    table = sorted({(rng.choice([1, 2, 3, 4, 500]), rng.randint(0, 60)) for _ in range(160)} | {(9, i) for i in range(200)})
    for size in (1, 7, 1000):
        parts = [table[i : i + size] for i in range(0, len(table), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([k << 16 for k, _ in p]), pa.array([i for _, i in p], pa.int32())], ["slot", "rest"]) for p in parts]
        got = []
        for b in neardup._pairs_in_buckets(iter(batches)):
            got += zip(*(b.column(n).to_pylist() for n in range(3)))
        want, crowd = set(), set()
        for bucket in {k for k, _ in table}:
            ids = [i for k, i in table if k == bucket]
            want |= {(-1, x, y) for n, y in enumerate(ids) for m, x in enumerate(ids[:n]) if n - m <= neardup.PRECEDING or m < neardup.FIRST}
            crowd |= {(n, bucket, y) for n, y in enumerate(ids) if n >= neardup.FIRST}
        assert set(got) == want | crowd


def test_blocks_give_the_other_pairs(spark):
    table = [(n, bucket, 10 * bucket + n) for bucket, size in ((1, 300), (2, 41), (3, 42), (4, 60)) for n in range(neardup.FIRST, size)]
    df = spark.createDataFrame(table + [(-1, 5, 6)], "rank long, a long, b long")
    got = rows(neardup._pairs_between_blocks(df))
    want = [(10 * b + i, 10 * b + j) for b, size in ((1, 300), (2, 41), (3, 42), (4, 60)) for j in range(size) for i in range(neardup.FIRST, j - neardup.PRECEDING)]
    assert got == sorted(want, key=str)


def mutate(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + "A" + s[i:], s[:i] + "C" + s[i + 1 :]])
    return s


def reads(rng):
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    adapter = dna(26)
    out = [dna(100) + adapter for _ in range(150)]
    base = [dna(150) for _ in range(40)]
    for b in base:
        out += [b, mutate(rng, b, 1), mutate(rng, b, 4), b[70:] + b[:70], b]
    hot = dna(150)
    out += [hot] * 120 + [mutate(rng, hot, 1) for _ in range(120)]
    out += ["ACGTACG", "", None, "*", "A" * 5000, "A" * 40, dna(20_000)]
    rng.shuffle(out)
    return out


def test_near_duplicates(spark):
    rng = random.Random(11)
    data = list(enumerate(reads(rng)))
    df = spark.createDataFrame([(i, s, "x") for i, s in data + data[:30]] + [(None, "ACGT" * 30, "x")], "id long, seq string, class_id string")
    members, links = neardup.near_duplicates(df, "id", "seq")
    kept = {i: s for i, s in data if s and s != "*"}
    first = {}
    for i, s in kept.items():
        first.setdefault(s, i)
    assert rows(members) == sorted(((i, first[s]) for i, s in kept.items()), key=str)
    texts = {i: s for s, i in first.items()}
    got = {(r.a, r.b): r.similarity for r in links.collect()}
    want = {(a, b): similarity(texts[a], texts[b]) for a in texts for b in texts if a < b and similarity(texts[a], texts[b]) >= 0.5}
    assert all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    hot = {first[s] for s in texts.values() if sum(similarity(s, t) >= 0.5 for t in texts.values()) > 60}
    assert set(got) == set(want)
    group = {r.rec_key: r.group_id for r in neardup.groups(members, links).collect()}
    assert len({group[i] for i in hot}) == 1
    assert len(group) == len(kept)
    for a, b in want:
        assert group[a] == group[b]
    pairs = {tuple(r) for r in neardup.record_pairs(members, links).collect()}
    plain = {(i, j) for i, s in kept.items() for j, t in kept.items() if i < j and (s == t or (min(first[s], first[t]), max(first[s], first[t])) in got)}
    assert pairs == plain


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, seq string")
    members, links = neardup.near_duplicates(df, "id", "seq")
    assert rows(members) == [] and rows(links) == [] and rows(neardup.groups(members, links)) == []


def test_oriented(spark):
    df = spark.createDataFrame([("acg tn", True), ("acgt", False), (None, True)], "s string, r boolean")
    assert [r[0] for r in df.select(neardup.oriented(F.col("s"), F.col("r"))).collect()] == ["NACGT", "ACGT", None]


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    rng.shuffle(chain)
    star = [(1000, 1000 + i) for i in range(1, 80)]
    df = spark.createDataFrame(chain + star + [(5, 4), (7, 7), (None, 3)], "a long, b long")
    got = dict(rows(components.components(df, "a", "b")))
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(80)}


@pytest.mark.parametrize("gathered", [50, 1 << 20])
def test_packed_buckets(monkeypatch, gathered):
    """Packed rows go through the shuffle as few rows, and come back sorted: each that shares its bucket, once."""
    monkeypatch.setattr(neardup, "GATHERED", gathered)
    monkeypatch.setattr(neardup, "PACKED", 7)
    monkeypatch.setattr(neardup, "RANGE", 20)
    rng = np.random.default_rng(3)
    buckets = np.r_[rng.integers(-(2**47), 2**47, 300), np.repeat(rng.integers(-(2**47), 2**47, 40), 3), np.repeat(rng.integers(-(2**47), 2**47, 1), 200)]
    slot = buckets << 16 | rng.integers(0, 3, len(buckets))
    rest = np.arange(len(buckets), dtype=np.int32)
    rest[-100:] = rest[-1]  # copies
    slot[-100:] = slot[-1]
    order = rng.permutation(len(slot))
    pieces = [(slot[o], rest[o]) for o in np.array_split(order, 9)]
    packed = pa.Table.from_batches(list(neardup._gathered(iter([*pieces, (slot[:0], rest[:0])]), 4)))
    assert max(len(x) for x in packed.column("slots").to_pylist()) <= 7 * 8
    for size in (3, 10_000):
        got = [(s, r) for b in neardup._shared_buckets(iter(packed.sort_by("range").to_batches(max_chunksize=size))) for s, r in zip(*(c.to_pylist() for c in b.columns))]
        assert [s for s, _ in got] == sorted((s for s, _ in got), key=lambda s: s & (1 << 64) - 1)
        n = {}
        for s, r in {(s, r) for s, r in zip(slot.tolist(), rest.tolist())}:
            n.setdefault(s >> 16, set()).add((s, r))
        want = {x for group in n.values() if len(group) > 1 for x in group}
        assert set(got) == want and len(got) <= len(want) + 100
    assert list(neardup._gathered(iter([]), 4)) == [] and list(neardup._shared_buckets(iter([]))) == []
