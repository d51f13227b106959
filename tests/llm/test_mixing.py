import os
import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import mixing
from tests.conftest import rows

SCHEMA = "doc_id long, source string, tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def brute(docs, targets, budget, hashes):
    """Sort by hash and take while the sum fits."""
    by, out, used = {}, {}, {}
    for i, s, n in docs:
        by.setdefault(s, []).append((i, n or 0))
    for s, items in by.items():
        share, cap = targets.get(s, (0, 0))
        total, want = sum(n for _, n in items), round(share * budget)
        passes = min(want // total, cap) if total else 0
        rest = want - passes * total if passes < cap else 0
        sums = 0
        for i, n in sorted(items, key=lambda x: hashes[x[0]] % 2**64):
            take = 0
            if rest > 0:
                sums += n
                take = int(sums <= rest)
            out[i] = passes + take
            used[s] = used.get(s, 0) + n * out[i]
    return out, used


@pytest.mark.parametrize("budget", [None, 0, 777, 60_000, 10**9])
def test_mix(spark, budget):
    rng = random.Random(budget or 1)
    docs = [(i, rng.choice(["big"] * 6 + ["a", "b", None, "no target"]), rng.choice([None, 0, 5, 17, 90])) for i in range(1500)]
    targets = [("a", 0.3, 4), ("b", 0.2, 1), ("big", 0.3, 2), ("missing", 0.2, 3), (None, 0.5, 2), ("none", None, None)]
    df = spark.createDataFrame(docs, SCHEMA)
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    uses, shares = mixing.mix(df, spark.createDataFrame(targets, TARGETS), budget)
    real = budget if budget is not None else sum(n or 0 for _, s, n in docs if s in ("a", "b", "big"))
    want, used = brute(docs, {s: (w, r) for s, w, r in targets if s and w}, real, hashes)
    assert {r.doc_id: r.n_used for r in uses.collect()} == want
    got = {r.source: r for r in shares.collect()}
    assert {s: r.used for s, r in got.items() if r.n_docs} == used
    assert set(got) == {"a", "b", "big", "missing", "none", "no target", None}
    total = sum(used.values())
    assert all(abs(r.share - (r.used / total if total else 0)) < 1e-12 for r in got.values())
    assert got["missing"].met == (round(0.2 * real) == 0)


def test_larger_budgets_take_supersets(spark):
    df = spark.createDataFrame([(i, "s", 10) for i in range(500)], SCHEMA)
    targets = spark.createDataFrame([("s", 1.0, 1)], TARGETS)
    small, large = ({r.doc_id for r in mixing.mix(df, targets, b)[0].filter("n_used > 0").collect()} for b in (905, 2700))
    assert len(small) == 90 and len(large) == 270 and small < large


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    targets = spark.createDataFrame([("s", 1.0, 1)], TARGETS)
    uses, shares = mixing.mix(none, targets)
    assert rows(uses) == [] and [(r.source, r.used, r.n_docs) for r in shares.collect()] == [("s", 0, 0)]
    uses, _ = mixing.mix(spark.createDataFrame([(1, "s", 5)], SCHEMA), targets.limit(0))
    assert rows(uses.select("n_used")) == [(0,)]


@pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no vocabulary files here")
def test_token_counts(spark):
    import tiktoken  # noqa: F401

    encode = mixing._encoding(mixing.VOCABULARY, mixing.PATTERN).encode_ordinary
    texts = [None, "", "The quay's flax, 29.40!", "<|endoftext|>", "霧浜 " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens string")
    got = mixing.token_counts(df.withColumnRenamed("tokens", "text"), ["doc_id"], "text")
    assert {r.doc_id: r.tokens for r in got.collect()} == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}
