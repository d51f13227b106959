import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandloom.kernels import trimming
from strandloom.kernels.aligner import revcomp
from strandloom.operators import kernel_ops as ko
from strandloom.plans import pipe
from tests.conftest import rows


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_trim_align_sort_call(spark):
    rng = random.Random(1)
    ref = dna(rng, 3000)
    alt = ref[:1500] + ("A" if ref[1500] != "A" else "C") + ref[1501:]
    pairs = []
    for n in range(160):
        src = ref if n % 2 else alt
        at = 1100 + 4 * n if n < 100 else rng.randint(0, 2500)
        piece = src[at : at + 400]
        pairs.append((f"q{n}", piece[:100], "I" * 100, revcomp(piece[-100:]), "I" * 100))
    df = spark.createDataFrame(pairs, "name string, seq1 string, qual1 string, seq2 string, qual2 string")
    reference = spark.createDataFrame([("c1", ref), ("c2", dna(rng, 900)), ("c0", None)], "name string, seq string")
    mapped = df.transform(pipe.trim(trimming.ADAPTERS)).transform(pipe.align(reference)).cache()
    assert mapped.count() == 320 and mapped.filter("rname = 'c1' and flag & 2 <> 0").count() >= 316
    called = mapped.transform(pipe.sort()).transform(pipe.call(reference)).collect()
    assert [(r.chrom, r.pos, r.ref, r.alt, r.genotype) for r in called] == [("c1", 1501, ref[1500], [alt[1500]], "0|1")]
    assert mapped.limit(0).transform(pipe.call(reference)).count() == 0
    blocks = ko.reference_blocks(reference, most=3000)
    assert [[n for n, _ in b] for b in blocks] == [["c1"], ["c2"]]
    pieces = [b[0] for b in ko.reference_blocks(reference, most=1000) if "\x1f" in b[0][0]]
    assert [(n.split("\x1f")[0], *map(int, n.split("\x1f")[1:]), len(t)) for n, t in pieces] == [("c1", a, min(a + 500, 3000) if a < 2000 else 3000, 1000) for a in range(0, 2001, 500)]
    assert all(t == ref[int(n.split("\x1f")[1]) :][:1000] for n, t in pieces)


def test_blocks_give_the_same_mapping(spark, monkeypatch):
    rng = random.Random(2)
    chroms = [(f"c{i}", dna(rng, 700)) for i in range(4)]
    reference = spark.createDataFrame(chroms, "name string, seq string")
    pairs = [(f"q{i}", s[100:200], "I" * 100, revcomp(s[400:500]), "I" * 100) for i, (_, s) in enumerate(chroms)]
    df = spark.createDataFrame(pairs, "name string, seq1 string, qual1 string, seq2 string, qual2 string")
    small = [(f"s{i}", s[300:325], "I" * 25) for i, (_, s) in enumerate(chroms)]
    sf = spark.createDataFrame(small, "name string, seq string, qual string")
    whole = [rows(ko.map_pairs(df, reference).select("qname", "flag", "rname", "pos")), rows(ko.map_small_rna(sf, reference).select("qname", "flag", "rname", "pos"))]
    original = ko.reference_blocks
    monkeypatch.setattr(ko, "reference_blocks", lambda r: original(r, most=1500))
    assert [rows(ko.map_pairs(df, reference).select("qname", "flag", "rname", "pos")), rows(ko.map_small_rna(sf, reference).select("qname", "flag", "rname", "pos"))] == whole
    assert [r[3] for r in whole[1]] == [301] * 4


def test_pieces_of_a_long_chromosome_give_the_same_mapping(spark, monkeypatch):
    rng = random.Random(12)
    long, twin = dna(rng, 6000), dna(rng, 40)
    long = long[:2480] + twin + long[2520:5000] + twin + long[5040:]
    reference = spark.createDataFrame([("b", dna(rng, 900)), ("long", long), ("z", dna(rng, 700))], "name string, seq string")
    pairs = [(f"q{a}", long[a : a + 100], "I" * 100, revcomp(long[a + 300 : a + 400]), "I" * 100) for a in range(0, 5600, 130)]
    df = spark.createDataFrame(pairs, "name string, seq1 string, qual1 string, seq2 string, qual2 string")
    small = [(f"s{a}", long[a : a + 25], "I" * 25) for a in range(0, 5900, 90)] + [("twin", twin[5:35], "I" * 30)]
    sf = spark.createDataFrame(small, "name string, seq string, qual string")
    columns = ["qname", "flag", "rname", "pos", "cigar", "rnext", "pnext", "tlen"]
    run = lambda: (rows(ko.map_pairs(df, reference).select(*columns)), rows(ko.map_small_rna(sf, reference).select(*columns, "optionals")))
    whole = run()
    original = ko.reference_blocks
    monkeypatch.setattr(ko, "reference_blocks", lambda r: original(r, most=2000))
    assert len(ko.reference_blocks(reference)) == 6
    assert run() == whole
    assert [r[-1] for r in whole[1] if r[0] == "twin"] == [["NH:i:2"]] * 2


def test_small_rna_counts(spark):
    rng = random.Random(3)
    text = dna(rng, 1500)
    reference = spark.createDataFrame([("chr1", text)], "name string, seq string")
    at = [100] * 20 + [400] * 10 + [700] * 5
    reads = spark.createDataFrame([(f"r{i}", text[a : a + 25], "I" * 25) for i, a in enumerate(at)] + [("x", dna(rng, 25), "I" * 25)], "name string, seq string, qual string")
    features = spark.createDataFrame([("chr1", 90, 150, "+", "g0"), ("chr1", 390, 450, "+", "g1"), ("chr1", 690, 750, "-", "g2"), ("chr1", 0, 10, "+", "g3")], "chrom string, begin long, end long, strand string, gene string")
    got = reads.transform(pipe.align_small_rna(reference)).transform(pipe.count_genes(features, "s"))
    assert rows(got) == [("s", "g0", 20), ("s", "g1", 10)]


def test_zip_and_detect(spark):
    rng = random.Random(4)
    a, b = trimming.ADAPTERS
    first, second = [], []
    for i in range(60):
        insert = dna(rng, rng.randint(40, 80))
        first.append((f"q{i}/1 x", (insert + a + dna(rng, 60))[:100], "I" * 100))
        second.append((f"q{i}/2", (revcomp(insert) + b + dna(rng, 60))[:100], "I" * 100))
    schema = "name string, seq string, qual string"
    pairs = spark.createDataFrame(first, schema).transform(pipe.zip_mates(spark.createDataFrame(second, schema)))
    assert pairs.count() == 60
    found = ko.detect_adapters(pairs)
    assert a.startswith(found[0]) and len(found[0]) >= 15
    kept = pairs.transform(pipe.trim())
    assert kept.filter(F.length("seq1").between(40, 80)).count() >= 58
    single = ko.trim_single(spark.createDataFrame([(1, "ACGTTGCATTGCAATCGGAT" + a), (2, None)], "id long, seq string"), "id", a)
    assert dict(rows(single)) == {1: 20, 2: 0}


def test_consensus_and_likelihoods(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(["ACGTACGT", "ACGTACGT", "ACGACGT", None, ""])] + [(None, 1, "A")], "k string, i int, s string")
    r = ko.consensus(df, "k", "i", "s").collect()
    assert len(r) == 1 and r[0].consensus == "ACGTACGT" and r[0].n_seqs == 3
    reads = spark.createDataFrame([("x", 1, "ACGTACGTAC", "I" * 10)], "region string, read int, seq string, qual string")
    haps = spark.createDataFrame([("x", 0, "TTACGTACGTACTT"), ("x", 1, "TTACGTTCGTACTT"), ("y", 0, "A")], "region string, haplotype int, seq string")
    lik = {r.haplotype: r.lik for r in ko.haplotype_likelihoods(reads, haps).collect()}
    assert lik[0] > lik[1] >= lik[0] - 4.5


def test_follow(spark, tmp_path):
    from strandloom.streaming.microbatch import follow

    src = tmp_path / "in"
    spark.range(10).selectExpr("id", "'ACGTNACGT' as seq").write.parquet(str(src))
    go = lambda: follow(spark, str(src), "id long, seq string", lambda df: df.withColumn("n", F.length("seq")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    spark.range(10, 15).selectExpr("id", "'AC' as seq").write.mode("append").parquet(str(src))
    go()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 15 and got.agg(F.sum("n")).first()[0] == 100


def test_entry_points(spark):
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 80
    core = Path(entry.__file__).parent / "strandloom"
    assert not [p for p in core.rglob("*.py") if "llm" not in p.parts and "strandloom.llm" in p.read_text()]


def test_entry_points_without_a_session():
    import subprocess
    import sys

    import __spark_entry__ as entry

    code = "import __spark_entry__ as e; print('NAMES', len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert out.stdout.startswith("NAMES "), out.stderr[-500:]


def test_mates_of_one_name_are_paired_one_by_one(spark):
    from strandloom.plans import pipe

    a = spark.createDataFrame([("x/1", "AC", "II"), ("x/1", "GG", "II"), ("y", "T", "I"), ("z/1", "A", "I")], "name string, seq string, qual string")
    b = spark.createDataFrame([("x/2", "CC", "II"), ("x/2", "TT", "II"), ("y c", "G", "I")], "name string, seq string, qual string")
    got = sorted((r.name, r.seq1, r.seq2) for r in a.transform(pipe.zip_mates(b)).collect())
    assert got == [("x", "AC", "CC"), ("x", "GG", "TT"), ("y", "T", "G")]


def test_sequences_of_one_name_are_an_error(spark):
    import pytest

    from strandloom.operators import kernel_ops

    df = spark.createDataFrame([("a", "ACGT"), ("a", "GGGT"), ("b", "")], "name string, seq string")
    with pytest.raises(ValueError, match="named a"):
        kernel_ops.reference_blocks(df)
    assert kernel_ops.reference_blocks(df.filter("seq <> 'ACGT'")) == [[("a", "GGGT")]]
