import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import pieces
from tests.conftest import rows


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.data())
@settings(max_examples=60, deadline=None)
def test_range_max(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo + 1, len(values)))
    got = pieces.RangeMax(np.array(values)).query(lo, hi)
    best = max(values[lo:hi])
    assert got == max(i for i in range(lo, hi) if values[i] == best)


def test_cut_invariants():
    rng = random.Random(1)
    for _ in range(200):
        s = "".join(rng.choice(["ACGT" * rng.randint(1, 30), "N" * rng.choice([rng.randint(1, 25), rng.randint(1, 25), 700]), "acg"]) for _ in range(rng.randint(0, 60)))
        runs = pieces.boundary_runs(s, 10)
        got = pieces.cut(len(s), runs, 200, 6)
        edges = {x for r in runs for x in r}
        strength = {x: b - a for a, b in runs for x in (a, b)}
        if not s:
            assert got == []
            continue
        assert got[0][0] == 0 and got[-1][1] == len(s)
        for (a, b, kind, free), (c, *_) in zip(got, got[1:]):
            assert b - a <= 200 and c == b - 6
            window = [e for e in edges if a + 6 < e <= a + 200]
            if kind == "boundary" and not window:
                assert b == a + 200 and any(x < b < y for x, y in runs)
            elif kind == "boundary":
                top = max(strength[e] for e in window)
                assert b == max(e for e in window if strength[e] == top)
            else:
                assert not window and b == a + 200
                before = [e for e in edges if e <= a + 6] + [0]
                assert free == min([e for e in edges if e > b] + [len(s)]) - max(before)
        stretches = [y - x for x, y in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(s)])]
        assert any(kind == "inside" and free > 200 for *_, kind, free in got) == (max(stretches) > 200)
        assert got[-1][1] - got[-1][0] <= 200


def test_split_records(spark):
    long = "ACGT" * 400 + "n" * 12 + "ACGT" * 300
    free = "A" * 2001
    df = spark.createDataFrame(
        [(1, "x desc", long, "p"), (2, None, free, "p"), (3, " ", "ac\n gt\r", "p"), (4, "y", None, "p"), (5, "y", " \n", "p"), (6, "z", "A" * 3_000_000, "p"), (3, " ", "ac\n gt\r", "p")],
        "rec_id long, name string, seq string, piece string",
    )
    out = pieces.split_records(df, "rec_id", "name", "seq")
    assert rows(pieces.oversized(out)) == [(1, "boundary"), (2, "inside"), (6, "inside")]
    got = {r.rec_key: r for r in out.filter("rec_key in (2, 3)").orderBy("piece_no").collect()}
    assert got[3].piece == "acgt" and got[3].piece_name == "rec3_0" and got[2].piece_name == "rec2_1"
    assert out.filter("rec_key = 3").count() == 2
    parts = out.filter("rec_key = 1").orderBy("piece_no").collect()
    assert parts[0].piece + parts[1].piece[60:] == long and parts[0].cut_kind == "boundary"
    assert out.filter("rec_key in (4, 5)").count() == 0 and out.filter("length(piece) > 2000").count() == 0
    assert pieces.split_records(df.limit(0), "rec_id", "name", "seq").count() == 0
