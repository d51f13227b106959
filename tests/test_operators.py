import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import expression as ex
from strandloom.operators import genome as gn
from strandloom.operators import genotyping as gt
from strandloom.operators import interval_join as ij
from strandloom.operators import order
from tests.conftest import rows


@pytest.mark.parametrize("width, part", [(1, 1000), (16, 1000), (16, 3), (16, 1), (None, 1000)])
def test_interval_join(spark, width, part):
    rng = random.Random(1)
    make = lambda n, first: [(first + i, rng.choice(["a", "b", None]), b := rng.choice([None, *range(60)]), None if b is None else b + rng.choice([0, 1, 5, 70])) for i in range(n)]
    left, right = make(60, 0), make(60, 100)
    left.append(left[0])
    schema = "id long, chrom string, begin long, end long"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    meet = lambda x, y: x[1] is not None and x[1] == y[1] and None not in (x[2], y[2]) and x[2] < y[3] and y[2] < x[3]
    pairs = sorted((x[0], y[0]) for x in left for y in right if meet(x, y))
    run = lambda how: ij.interval_join(a, b, ["chrom"], how, width=width, part=part)
    assert sorted((r.id, r.r_id) for r in run("inner").collect()) == pairs
    hit = {x for x, _ in pairs}
    assert sorted(r.id for r in run("semi").collect()) == sorted(x[0] for x in left if x[0] in hit)
    assert sorted(r.id for r in run("anti").collect()) == sorted(x[0] for x in left if x[0] not in hit)
    assert sorted((r.id, r.n_overlaps) for r in run("count").collect()) == sorted((x[0], sum(meet(x, y) for y in right)) for x in left)
    assert sorted(str((r.id, r.r_id)) for r in run("left").collect()) == sorted([str(p) for p in pairs] + [str((x[0], None)) for x in left if x[0] not in hit])


def test_interval_join_goldens(spark):
    f = spark.createDataFrame([("gene1", "chr1", "+", 5, 15), ("gene2", "chr1", "+", 2, 10), ("gene3", "chr1", "+", 20, 30), ("gene4", "chr2", "-", 2, 10)], "name string, chrom string, strand string, begin long, end long")
    q = spark.createDataFrame([(1, "chr1", "+", 6, 12), (2, "chr2", "-", 6, 9), (3, "chr2", "+", 6, 9), (4, "chr2", "+", 0, 2), (5, "chr999", "+", 5, 6)], "id long, chrom string, strand string, begin long, end long")
    got = ij.interval_join(q, f, ["chrom", "strand"])
    assert sorted((r.id, r.r_begin, r.r_name) for r in got.collect()) == [(1, 2, "gene2"), (1, 5, "gene1"), (2, 2, "gene4")]
    with pytest.raises(ValueError):
        ij.interval_join(q, f, ["chrom"], "full")
    assert ij.interval_join(q, f.limit(0), ["chrom"], "count").agg(F.sum("n_overlaps")).first()[0] == 0


def test_band_join_and_enclosing_range(spark):
    rng = random.Random(2)
    a = [(i, rng.choice("xy"), rng.randint(-50, 300)) for i in range(80)]
    df = spark.createDataFrame(a, "id long, k string, pos long")
    got = {(r.id, r.r_id) for r in ij.band_join(df, df, ["k"], "pos", "pos", 7, 12).collect()}
    assert got == {(x[0], y[0]) for x in a for y in a if x[1] == y[1] and x[2] - 7 <= y[2] < x[2] + 12}
    p = spark.createDataFrame([(i, v) for i, v in enumerate([-1, 0, 9, 10, 5_000_000, 2**21, None])], "i long, p long")
    g = spark.createDataFrame([("a", 0, 10), ("b", 11, 2**21), ("c", 4_000_000, 6_000_000), ("e", 3, 3)], "n string, b long, e long")
    assert rows(ij.enclosing_range(p, "p", g, "b", "e").select("i", "n")) == [(1, "a"), (2, "a"), (4, "c")]


EXPRESSION = [(0, "gene1", 15.0), (0, "gene2", 12.5), (0, "gene3", 22.5), (0, "gene4", 1.25), (0, "gene5", 8.75), (1, "gene1", 100.0), (1, "gene3", 155.0), (1, "gene4", 12.25), (1, "gene6", 71.25), (1, "gene9", 36.5), (2, "gene1", 4.05), (2, "gene3", 8.95), (2, "gene4", 0.375), (2, "gene5", 2.625), (2, "gene8", 6.5), (2, "gene9", 7.5)]


def test_expression_goldens(spark):
    m = spark.createDataFrame(EXPRESSION, "sample int, gene string, value double")
    size = {(r["sample"], r.gene): r.value for r in ex.size_normalised(m).collect()}
    assert [round(size[k], 6) for k in ((0, "gene1"), (0, "gene3"), (1, "gene6"), (2, "gene1"), (2, "gene9"))] == [0.25, 0.375, 0.19, 0.135, 0.25]
    assert ex.filled(m).count() == 24
    assert ex.tmm_reference(ex.filled(m)).first()[0] == 0
    got = {r["sample"]: (r.raw, r.factor) for r in ex.tmm_factors(m).collect()}
    for s, raw, factor in ((0, 1.0, 1.14902526), (1, 1.0986516715, 1.2623785225), (2, 0.6, 0.689415156)):
        assert got[s] == (pytest.approx(raw, abs=1e-8), pytest.approx(factor, abs=1e-8))
    assert {(r["sample"], r.gene): r.value for r in ex.tmm_normalised(m).collect()}[0, "gene1"] == pytest.approx(13.0545432912)
    q = spark.createDataFrame([(s, g, float(v)) for s, vs in enumerate([(5, 2, 3, 4), (4, 1, 4, 2), (3, 4, 6, 8)], 1) for g, v in zip("ABCD", vs)], "sample int, gene string, value double")
    norm = {(r["sample"], r.gene): r.normalised for r in ex.quantile_normalised(q).collect()}
    want = {1: (5.6666666667, 2, 3, 4.6666666667), 2: (5.1666666667, 2, 5.1666666667, 3), 3: (2, 3, 4.6666666667, 5.6666666667)}
    assert all(norm[s, g] == pytest.approx(v) for s, vs in want.items() for g, v in zip("ABCD", vs))
    assert ex.filled(m.limit(0)).count() == 0 and ex.tmm_factors(m.limit(0)).count() == 0


def test_tailed_expression(spark):
    t = spark.createDataFrame([("g", "ACGTAA", 4, 2), ("g", "ACGTAC", 4, 1), ("g", "ACGT", -1, 4), ("g", "ACGTU", 4, 1), ("g", "ACG", -1, 0), ("g", "ACGTAA", 4, 2)], "gene string, seq string, tail_pos int, hits int")
    e = ex.tailed_expression(t, "gene", "seq", "tail_pos", "hits")
    assert rows(e) == [("g", 0, 4, 1.0), ("g", 3, 4, 1.0), ("g", 4, 4, 1.0), ("g", 5, 4, 0.25)]
    assert tuple(ex.by_length(e).first()) == ("g", 4, 1.0, 0.0, 0.0, 1.0, 1.0, 0.25) and ex.tailed_sum(e).first().value == 3.0


def test_genome(spark):
    f = spark.createDataFrame([("a", "NNACg\ntnAA"), ("b", None), ("c", "")], "name string, seq string")
    assert dict(rows(gn.base_counts(f, "seq"))) == {"A": 3, "C": 1, "G": 1, "T": 1, "N": 3}
    assert rows(gn.unknown_runs(f, "name", "seq")) == [("a", 0, 2), ("a", 6, 7)]
    t = spark.createDataFrame([(0,), (99,), (250,), (-1,)], "begin long")
    assert rows(gn.tiles(t, "begin")) == sorted([(0, 0), (99, 0), (250, 0), (250, 1), (250, 2)], key=str)
    ref = spark.createDataFrame([("c", "ACGTACGT"), ("d", "AA")], "chrom string, seq string")
    v = spark.createDataFrame([("c", 2, "CG", "T"), ("c", 3, "G", "A"), ("c", 5, ".", "GG"), ("c", 8, "T", "."), ("x", 1, "A", "C"), ("c", None, "A", "C")], "chrom string, pos long, ref string, alt string")
    assert dict(rows(gn.consensus(ref, v))) == {"c": "ATTGGACG", "d": "AA"}
    s = spark.createDataFrame([(1, x) for x in range(1, 11)] + [(2, 5), (3, None)], "k long, score long")
    got = {r.k: (r.best, r.second, r.n_second) for r in gn.score_summary(s, ["k"], "score").collect()}
    assert got == {1: (10, 9, 6), 2: (5, 0, 0)}
    assert {r.k for r in gn.score_band(s, ["k"], "score", 3).filter("score < 7").collect()} == {2}


def test_ranked(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([None, *range(20)])) for i in range(300)]
    df = spark.createDataFrame(data, "id long, v long")
    got = sorted((r.place, r.v, r.id) for r in order.ranked(df.repartition(5), ["v", "id"], "place").collect())
    want = sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert [(g[2], g[1]) for g in got] == want and [g[0] for g in got] == list(range(1, 301))
    x = spark.createDataFrame([([3, 5, 9],), ([4],), ([],)], "xs array<int>")
    assert [(r[0], r[1]) for r in x.select(order.differences(F.col("xs")), order.second_smallest(F.col("xs"))).collect()] == [([3, 2, 4], 5), ([4], None), ([], None)]


def test_genotype_aggregates(spark):
    lik = [("l", r, a, v) for r, vs in enumerate([(-1.0, -3.0), (-2.0, -2.1), (-4.0, -0.5)]) for a, v in enumerate(vs)]
    df = spark.createDataFrame(lik, "locus string, read int, allele int, lik double")
    assert rows(gt.depth_per_allele(df, ["locus"], "read", "allele", "lik")) == [("l", 0, 1), ("l", 1, 1)]
    got = {(r.a, r.b): r.lik for r in gt.genotype_likelihoods(df, ["locus"], "read", "allele", "lik").collect()}
    assert got[0, 0] == pytest.approx(-7.0) and got[1, 1] == pytest.approx(-5.6)
    assert got[0, 1] == pytest.approx(sum(math.log10((10**a + 10**b) / 2) for a, b in [(-1, -3), (-2, -2.1), (-4, -0.5)]))
    assert gt.log10_sum(df, ["locus"], "lik").first().total == pytest.approx(math.log10(sum(10**v for *_, v in lik)))


def test_reference_confidence(spark):
    from strandloom.kernels import genotyping as kernel

    pile = [("A", 30), ("A", 20), ("C", 25), ("A", 12)]
    df = spark.createDataFrame([("k", b, q, "A") for b, q in pile] + [("k", None, 9, "A"), ("k", "A", 0, "A")], "k string, b string, q int, r string")
    r = gt.reference_confidence(df, ["k"], "b", "q", "r").first()
    want = kernel.reference_confidence("AACA", [30, 20, 25, 12], "A")
    assert r.depth == 4 and [r.hom_ref, r.het, r.hom_alt] == [pytest.approx(x) for x in want]
    assert gt.reference_confidence(df.limit(0), ["k"], "b", "q", "r").count() == 0
