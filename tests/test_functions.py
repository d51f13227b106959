import math

import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import intervals as iv
from strandloom.functions import mathx as mx
from strandloom.functions import quality as ql
from strandloom.functions import sam as sm
from strandloom.functions import seq as sq
from strandloom.functions import variant as vr


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    r = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return list(r) if len(cols) > 1 else r[0]


def test_sequence(spark):
    s = F.col("s")
    assert one(spark, sq.pack(s), sq.unpack(sq.pack(s), 5), sq.reverse_complement(s), sq.dna4(s), s=("ACGTN")) == [108, "ACGTA", "NACGT", "ACGTA"]
    assert one(spark, sq.reverse_complement(s), sq.codes(s), sq.from_codes(sq.codes(s)), s="aCgR") == ["NCGT", [0, 1, 2, 4], "ACGN"]
    assert one(spark, sq.kmers(s, 3), sq.kmers(s, 5), sq.kmers(s, 2, 2), s="ACGT") == [["ACG", "CGT"], [], ["AC", "GT"]]
    assert one(spark, sq.pack(s), sq.codes(s), sq.low_complexity(s), sq.reverse_complement(s), sq.letters(s), s="") == [0, [], False, "", []]
    assert one(spark, sq.pack(s), sq.codes(s), sq.low_complexity(s), s=None) == [None, None, False]
    assert one(spark, sq.low_complexity(s), sq.split_at_unknown(s, 2), s="AAAANAC") == [True, ["AAAA", "AC"]]
    assert one(spark, sq.similarity(s, F.lit("ACCA")), sq.mismatches(s, F.lit("ACCA")), s="ACGTT") == [0.5, 2]
    q = F.col("q")
    assert one(spark, sq.usable_segments(s, q, 2), s="ACGTNAC", q="II#IIII") == ["AC", "AC"]
    runs = F.array(F.struct(F.lit(1).cast("long").alias("begin"), F.lit(3).cast("long").alias("end")))
    assert one(spark, sq.with_runs(s, runs), s="AAAA") == "ANNA"
    assert one(spark, sq.kmer_hits(s, F.lit("ACGTACGTTT"), 4, 3), s="ACGTACGAAA") == 2


def test_cigar(spark):
    x = cg.parse(F.col("c"))
    assert one(spark, cg.ref_size(x), cg.read_size(x), cg.clip_size(x), cg.show(cg.reverse(x)), c="6H4S6M14N1I5M2D3X") == [30, 19, 10, "3X2D5M1I14N6M4S6H"]
    assert one(spark, cg.show(cg.compact(x)), cg.contains(x, "I"), c="3M2M1S1S4M") == ["5M2S4M", False]
    assert one(spark, F.size(x), cg.show(x), cg.ref_size(x), c="*") == [0, "*", 0]


@pytest.mark.parametrize("pos, cigar, fwd, mate, mate_cigar, mate_fwd, want", [
    (30902376, "86S27M35S", False, 42046135, "148M", False, 11143881),
    (36254854, "148M", True, 19146290, "148M", True, -17108565),
    (22691979, "2S146M", False, 22691980, "148M", True, -145),
    (25686371, "148M", False, 25982457, "148M", True, 295940),
])
def test_template_length(spark, pos, cigar, fwd, mate, mate_cigar, mate_fwd, want):
    got = one(spark, sm.template_length(F.col("p"), cg.parse(F.col("c")), F.lit(fwd), F.col("m"), cg.parse(F.col("d")), F.lit(mate_fwd)), p=pos, c=cigar, m=mate, d=mate_cigar)
    assert got == want


def test_alignments(spark):
    f = F.col("f")
    assert one(spark, sm.has_flag(f, "read_reverse_strand"), sm.has_flag(f, "duplicate_read"), sm.has_flag(F.lit(None), "duplicate_read"), f=16) == [True, False, False]
    assert one(spark, sm.mate_begin(F.col("n"), F.col("t")), sm.mate_begin(F.col("n"), F.col("t"), True), n=10, t=200) == [9, 199]
    c = cg.parse(F.col("c"))
    assert one(spark, sm.hard_clip(F.col("s"), c), c="2S3M1S", s="ABCDEF") == "CDE"
    fwd = sm.revert_soft_clips(F.col("p"), c, F.col("s"), F.col("s"), F.lit(False))
    rev = sm.revert_soft_clips(F.col("p"), c, F.col("s"), F.col("s"), F.lit(True))
    got = one(spark, fwd["pos"], cg.show(fwd["steps"]), fwd["seq"], rev["pos"], cg.show(rev["steps"]), rev["seq"], p=10, c="2S3M1S", s="ABCDEF")
    assert got == [8, "5M", "ABCDE", 10, "4M", "CDEF"]
    assert one(spark, fwd["pos"], cg.show(fwd["steps"]), fwd["seq"], p=2, c="2S3M1S", s="ABCDEF") == [2, "2S3M", "ABCDE"]
    assert one(spark, sm.clip_to(F.col("s"), F.lit(10), F.lit(12), F.lit(14)), sm.clip_to(F.col("s"), F.lit(10), F.lit(90), F.lit(99)), s="ABCDEF") == ["CD", ""]
    assert one(spark, sm.gap_penalties(F.length("s"), sm.GAP_OPEN), s="ACG") == "III"


def test_quality(spark):
    q = F.col("q")
    assert one(spark, ql.phred(q), ql.phred(q, True), ql.error_probability(q), q="5") == [20, 53, pytest.approx(0.01)]
    assert one(spark, ql.mean_quality(q), ql.trim_end(F.lit("ACGTA"), q, 20), q="II#I#") == [pytest.approx(24.8), "ACGT"]
    assert one(spark, ql.mean_quality(q), ql.trim_end(F.lit(""), q, 20), ql.blurry(q), q="") == [None, "", False]
    assert one(spark, ql.trim_end(F.lit("AC"), q, 20), ql.blurry(F.lit("ANN")), q="##") == ["", True]
    assert one(spark, ql.log10_correct_probability(q), q="!") is None


@pytest.mark.parametrize("text, want", [
    ("+chr1:10-2,000", ("chr1", 10, 2000, "+")), ("chr1:10-2,000", ("chr1", 10, 2000, "+")), ("-chr1:10-2,000", ("chr1", 10, 2000, "-")),
    ("chr1", ("chr1", 0, 4294967295, "+")), ("chr1:13+", ("chr1", 13, 4294967295, "+")), ("chr1:13", ("chr1", 13, 14, "+")),
])
def test_interval_parse(spark, text, want):
    assert tuple(one(spark, iv.parse(F.col("t")), t=text)) == want


def test_intervals(spark):
    p = iv.parse
    t = F.col("t")
    for bad in ("chr1:9-3", "!chr1:1-x"):
        with pytest.raises(Exception):
            one(spark, p(t), t=bad)
    assert one(spark, p(t), t=None) is None
    for other, want in (("chr1:150-200", False), ("chr1:70-100", False), ("chr1:149-150", True), ("-chr1:110-120", False), ("chr2:110-120", False), ("chr1:120-120", True)):
        assert one(spark, iv.overlaps(p(t), p(F.col("o"))), t="chr1:100-150", o=other) is want
    assert one(spark, iv.contains(p(t), p(F.lit("chr1:100-120"))), iv.size(p(t)), iv.show(p(t)), t="chr1:100-150") == [True, 50, "+chr1:100-150"]
    assert tuple(one(spark, iv.span(p(t), p(F.lit("chr1:90-120"))), t="chr1:100-150")) == ("chr1", 90, 150, "+")
    with pytest.raises(Exception):
        one(spark, iv.span(p(t), p(F.lit("chr2:90-120"))), t="chr1:100-150")
    a, b = one(spark, iv.expand(p(t), 20), iv.expand(p(t), 20, True), t="chr1:10-30")
    assert (a["begin"], a["end"], b["begin"]) == (0, 50, (1 << 32) - 10)


def test_mathematics(spark):
    x = F.col("x")
    assert one(spark, mx.log10_sum(x, F.lit(-2.0)), mx.log1mexp(x), mx.log10_one_minus_pow10(x), x=-1.0) == [pytest.approx(math.log10(0.11)), pytest.approx(math.log(1 - math.exp(-1))), pytest.approx(math.log10(0.9))]
    assert one(spark, mx.log1mexp(x), mx.log10_one_minus_pow10(x), x=0.0) == [None, None]
    assert one(spark, mx.approximate_log10_sum(x, F.lit(-20.0)), x=-1.0) == -1.0
    assert one(spark, mx.likelihoods_to_phred(F.array(x, F.lit(0.0))), mx.index_of(F.array(x), F.lit(5.0)), x=-3.25) == [[33, 0], 1]
    assert mx.genotypes(3) == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)] and mx.raw_genotypes(2) == [(0, 0), (0, 1), (1, 1)]
    with pytest.raises(ValueError):
        mx.genotypes(8)
    assert one(spark, mx.genotype_count(F.col("n")), mx.allele_count(mx.genotype_count(F.col("n"))), n=7) == [28, 7]
    assert one(spark, mx.mapq_single(F.lit(100), F.lit(0), F.lit(100), F.lit(0), F.lit(0.0), F.lit(0)), n=1) == 60
    assert one(spark, mx.mapq_single(F.lit(30), F.lit(30), F.lit(30), F.lit(1), F.lit(0.0), F.lit(0)), n=1) == 0
    assert one(spark, mx.insert_penalty(F.col("n")), mx.raw_mapq(F.col("n") - 549), n=1000) == [9, 2715]


def test_variants(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, vr.kind(a, b), vr.kind(b, a), vr.kind(a, a), a="A", b="AC") == ["insertion", "deletion", "snp"]
    assert abs(vr.fisher_exact(3, 1, 1, 3) - 0.485714) < 1e-5 and vr.fisher_exact(0, 0, 0, 0) == 1.0
    assert one(spark, vr.fisher_strand(F.col("n"), F.lit(1), F.lit(1), F.col("n")), vr.fisher_strand(F.lit(None).cast("long"), F.lit(1), F.lit(1), F.lit(1)), n=500)[1] is None


def test_gamma_weights_and_array_helpers(spark):
    import math

    from pyspark.sql import functions as F

    from strandloom.functions import mathx as mx

    xs = [1e-3, 0.5, 1.0, 1.5, 2.0, 3.7, 9.99, 10.0, 50.0, 1e6]
    df = spark.createDataFrame([(x,) for x in [*xs, 0.0, -1.0]] + [(None,)], "x double")
    got = {r.x: r.g for r in df.select("x", mx.log10_gamma(F.col("x")).alias("g")).collect()}
    assert all(math.isclose(got[x], math.lgamma(x) / math.log(10), rel_tol=1e-9, abs_tol=1e-9) for x in xs)
    assert got[0.0] is None and got[-1.0] is None and got[None] is None
    one = spark.createDataFrame([([1.0, 3.0], [2.0, 5.0], [1.0])], "a array<double>, b array<double>, c array<double>")
    plus = lambda x, y: x + y
    r = one.select(mx.sum_log10(F.col("a")).alias("s"), mx.dirichlet_log10_mean_weights(F.col("a")).alias("w"), mx.binary_transform(F.col("a"), F.col("b"), plus).alias("p"), mx.binary_transform(F.col("a"), F.col("c"), plus).alias("n"), mx.format_print(F.col("b"), ";").alias("t")).first()
    assert math.isclose(r.s, 1010.0) and r.p == [3.0, 8.0] and r.n is None and r.t == "2.0;5.0"
    assert [round(x, 6) for x in r.w] == [round(math.log10(x), 6) for x in (0.25, 0.75)]


def test_kmer_hits(spark):
    from pyspark.sql import functions as F

    from strandloom.functions import seq as sq

    q = "ACGTACGTTTGCAACGTACGTA"
    df = spark.createDataFrame([(q, q), (q, ""), ("ACG", q), (q, None)], "q string, w string")
    assert [r[0] for r in df.select(sq.kmer_hits(F.col("q"), F.col("w"))).collect()] == [3, 0, 0, 0]
