import random

import numpy as np
import pytest

from strandloom.llm import shared_spans
from tests.conftest import rows


def brute(recs, least=64):
    seqs = {}
    for k, s in recs:
        if k is not None and s is not None:
            seqs.setdefault(k, []).append("".join(s.split()).upper())
    where = {}
    for k, group in seqs.items():
        for s in group:
            for i in range(len(s) - least + 1):
                if set(s[i : i + least]) <= set("ACGT"):
                    where.setdefault(s[i : i + least], set()).add((k, i))
    hit = {}
    for places in where.values():
        if len({k for k, _ in places}) > 1:
            for k, i in places:
                hit.setdefault(k, set()).update(range(i, i + least))
    out = []
    for k, bases in hit.items():
        for x in sorted(bases):
            if x - 1 not in bases:
                start = x
            if x + 1 not in bases:
                out.append((k, start, x + 1))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, most, block", [(64, 1 << 19, 1 << 20), (64, 3, 300), (40, 1 << 19, 1 << 20), (100, 5, 1 << 20), (7, 40, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, least, most, block):
    monkeypatch.setattr(shared_spans, "MOST_SEEDS", most)
    monkeypatch.setattr(shared_spans, "LETTERS", block)
    monkeypatch.setattr(shared_spans, "TILE", block)
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pool = [dna(n) for n in (63, 64, 65, 100, 300)]
    recs = []
    for i in range(60):
        s = "".join(rng.choice([dna(rng.randint(1, 90)), rng.choice(pool), "N", rng.choice(pool)[: rng.randint(50, 90)]]) for _ in range(6))
        s = "".join(c + rng.choice(["", "", "", "", "\n"]) for c in s) if i % 3 else s.lower()
        recs.append((i, s))
    recs += [(100 + i, pool[4]) for i in range(40)] + [(7, recs[7][1]), (200, None), (None, pool[3]), (201, ""), (202, "A" * 200), (203, "A" * 63), (204, "C" * 150), (205, "C" * 80)]
    df = spark.createDataFrame([(k, s, 0) for k, s in recs], "rec_id long, seq string, at int")
    spans = shared_spans.shared_spans(df, "rec_id", "seq", least)
    assert rows(spans) == brute(recs, least)
    share = {r.rec_key: (r.n_bases, r.n_shared) for r in shared_spans.shared_share(df, "rec_id", "seq", spans).collect()}
    if least != 64:
        return
    assert share[204] == (150, 150) and share[202] == (200, 0) and share[200] == (0, 0)


def test_one_record_sent_twice_and_empty(spark):
    df = spark.createDataFrame([(1, "ACGTTGCA" * 20), (1, "ACGTTGCA" * 20)], "rec_id long, seq string")
    assert rows(shared_spans.shared_spans(df, "rec_id", "seq")) == []
    assert rows(shared_spans.shared_spans(df.limit(0), "rec_id", "seq")) == []


@pytest.mark.parametrize("size", [1, 5, 16, 20, 31, 32])
def test_words_of_any_size(size):
    rng = random.Random(size)
    text = "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(200))
    w, ok = shared_spans.words(shared_spans.letters(text), size)
    assert len(w) == 201 - size
    for i in range(len(w)):
        part = text[i : i + size]
        assert ok[i] == ("N" not in part)
        if ok[i]:
            assert int(w[i]) == sum("ACGT".index(c) << 2 * (size - 1 - j) for j, c in enumerate(part))


def test_settled_seeds_leave_two_records():
    c = [np.array([7] * 6), np.array([3, 1, 2, 2, 5, 9]), np.arange(6), np.array([4] * 5 + [3], np.int16), np.array([4] * 6, np.int16), np.zeros(6, np.int64), np.zeros(6, np.int64)]
    got = shared_spans._settled(c, 4)
    assert got[3].tolist() == [-1, 4, -1, -1, 4, 3] and got[0][[1, 4, 5]].tolist() == [7, 7, 7]
