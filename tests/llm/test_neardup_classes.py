"""Pairs at the threshold whose records have different shares of words that very many records share."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import neardup
from tests.llm.test_neardup import similarity

N = 200


def planted(kind):
    """200 pairs of similarity 0.5 or a little more, and 1,000 other reads that carry the common parts too."""
    rng = random.Random(kind)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    parts = [dna(120) for _ in range(3)]

    def pair():
        for _ in range(10_000):
            if kind == "none":
                core = dna(100 + rng.randint(0, 8))
                a, b = core + dna(50), dna(50) + core
            elif kind == "equal":  # about 70 % uncommon both, the common rest equal
                c, core = parts[0][:50], dna(62 + rng.randint(0, 6))
                a, b = c + core + dna(45), c + dna(45) + core
            elif kind == "mixed":  # 71 % uncommon against 39 %
                c, core = parts[0], dna(66)
                a, b = c[:46] + core + dna(40), c[:46] + core + c[46:106]
            else:  # mostly common both
                c = parts[0][:100]
                a, b = c + dna(45 + rng.randint(0, 8)), c + dna(45)
            if 0.5 <= similarity(a, b) <= 0.54:
                return a, b
        raise AssertionError(kind)

    pairs = [pair() for _ in range(N)]
    others = [dna(60) + p[rng.randint(0, 20) :] if rng.random() < 0.5 else p + dna(60) for p in (rng.choice(parts) for _ in range(1000))]
    return pairs, others


@pytest.mark.parametrize("kind", ["none", "equal", "mixed", "common"])
def test_recall_by_share_of_common_words(spark, kind):
    pairs, others = planted(kind)
    texts = [t for p in pairs for t in p] + others
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    members, links = neardup.near_duplicates(df, "id", "seq")
    found = {(r.a, r.b) for r in links.collect()}
    met = sum((2 * i, 2 * i + 1) in found for i in range(N))
    print(kind, met)
    assert met >= 0.95 * N


def test_bands_grow_with_the_share_of_common_words():
    share = np.array([0.0, 0.05, 0.1, 0.2, 0.3, 0.9])
    n = neardup.bands_for(0.5, share)
    assert list(n) == sorted(n) and n[-1] == n[-2]
    for c, k in zip(share[:5], n):
        assert 1 - (1 - ((0.5 - c) / (1 - c)) ** neardup.ROWS) ** k >= neardup.CHANCE


def test_similarities():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT" if i % 3 else "ACGTN") for _ in range(rng.choice([0, 7, 8, 30, 90]))) for i in range(200)]
    other = [t[5:] + t[:20] if rng.random() < 0.5 else rng.choice(texts) for t in texts]
    got = neardup.similarities(pa.array(texts), pa.array(other))
    assert np.allclose(got, [similarity(a, b) for a, b in zip(texts, other)])
    assert len(neardup.similarities(pa.array([], pa.string()), pa.array([], pa.string()))) == 0


def test_slices_are_bounded_by_letters(monkeypatch):
    monkeypatch.setattr(neardup, "LETTERS", 100)
    sizes = [10, 60, 40, 300, 5, None, 99, 1, 1] + [0] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if n is None else "A" * n for n in sizes])], ["i", "t"])
    parts = list(neardup._slices(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]), 8))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [*range(len(sizes)), 3, 4]
    for p in parts:
        total = sum(len(t or "") for t in p.column(1).to_pylist())
        assert p.num_rows <= 8 and (total <= 100 or p.num_rows == 1)
