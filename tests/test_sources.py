import gzip
import random

import pytest

from strandloom import sources
from strandloom.sources import sinks, streams, text
from tests.conftest import rows


def frame(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">one first record\nACGT\nAC\n\nGG\r\n>two\n\n>three\nTT")
    assert rows(sources.read(spark, str(p))) == sorted([("one first record", "ACGTACGG"), ("two", ""), ("three", "TT")], key=str)
    z = tmp_path / "b.fasta.gz"
    z.write_bytes(gzip.compress(b">x\nAC\nGT\n"))
    assert rows(sources.read(spark, str(z))) == [("x", "ACGT")]


@pytest.mark.parametrize("split", [20, 64, 1000, 1 << 20])
def test_fastq_in_byte_ranges(spark, tmp_path, split):
    rng = random.Random(split)
    want = []
    for i in range(60):
        n = rng.randint(1, 30)
        want.append((f"r{i}/1", "".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("@+IF#") for _ in range(n))))
    p = tmp_path / "a.fq"
    p.write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in want))
    streams.register(spark)
    got = spark.read.format("fastq").option("path", str(p)).option("splitBytes", split).load()
    assert rows(got) == sorted(want, key=str)


def test_fastq_over_several_lines():
    lines = iter(["@a x", "AC", "GT", "+", "@I", "+I", "", "@b", "A", "+b", "@", "@c", "", "+", ""])
    assert list(streams.fastq_records(lines)) == [("a x", "ACGT", "@I+I"), ("b", "A", "@"), ("c", "", "")]
    with pytest.raises(ValueError):
        list(streams.fastq_records(iter(["@a", "ACG", "+", "II"])))


def test_wig(spark, tmp_path):
    p = tmp_path / "a.wig"
    p.write_text("browser hide all\n#c\ntrack type=wiggle_0 name=tides\nvariableStep chrom=chrQ7 span=40\n8123 3.25\n9007 0.5\nfixedStep chrom=chrK2 start=61 step=70 span=35\n18\n27\n")
    assert rows(sources.read(spark, str(p))) == sorted([("chrQ7", 8123, 40, 3.25), ("chrQ7", 9007, 40, 0.5), ("chrK2", 61, 35, 18.0), ("chrK2", 131, 35, 27.0)], key=str)


def test_line_formats(spark, tmp_path):
    def read(name, body):
        p = tmp_path / name
        p.write_text(body)
        return sources.read(spark, str(p)).collect()

    sam = read("a.sam", "@HD\tVN:1\nlark\t16\tquayside\t812\t11\t3M9N2I4M\t*\t0\t0\tGGCATTACA\t*\nwren\t83\tquayside\t55\t44\t5M\t=\t20\t-40\tCATGA\t*\tNM:i:3\tZQ:B:S,8\n")
    assert sam[0].optionals == [] and sam[1].optionals == ["NM:i:3", "ZQ:B:S,8"] and sam[1].pos == 55
    vcf = read("a.vcf", "##fileformat=VCFv4.3\n#CHROM\nK4\t70215\tlark9\tC\tCA,G\t12.5\tlow\tDP=8\tGT:DP\t0|1:4\t1|1:3\t0|2:1\n")
    assert (vcf[0].chrom, vcf[0].pos, vcf[0].qual, len(vcf[0].samples)) == ("K4", 70215, 12.5, 3)
    bed = read("a.bed", "browser x\ntrack y\nchr1\t1\t5\nchr2\t3\t9\tn\t7\t-\t3\t9\t1,2,3\t2\t1,2,\t0,3,\n")
    assert (bed[0].start, bed[0].score, bed[0].item_rgb, bed[0].block_sizes, bed[0].name) == (1, 0, "0,0,0", "0", None)
    assert bed[1].block_count == 2
    graph = read("a.bedgraph", "track\nchr1\t0\t9\t1.5\n")
    assert tuple(graph[0]) == ("chr1", 0, 9, 1.5)
    gff = read("a.gtf", '#x\nchrK\tmill\tgene\t811\t946\t.\t+\t.\tgene_id "a b"; level 2;\n')
    assert (gff[0].start, gff[0].score, gff[0].phase) == (811, 0.0, 0)
    assert gff[0].attributes == {"gene_id": "a b", "level": "2"}
    assert read("b.gff3", "chr1\t.\tx\t1\t2\t.\t+\t.\tID=x;Name=y\n")[0].attributes == {"ID": "x", "Name": "y"}
    assert text.header(spark, str(tmp_path / "a.vcf"), "vcf").count() == 2
    with pytest.raises(ValueError):
        sources.kind_of("a.txt")
    with pytest.raises(Exception):
        text.read_sam(spark, str(tmp_path / "none.sam")).count()


def test_annotations(spark):
    mirtron = frame(spark, ["##gff", "seq_id\tsource\ttype\tstart\tend\tscore\tstrand\tphase\tatributtes", "K3 \t own \t kind \t 2401 \t 2430 \t . \t + \t . \t mirtronDB_id:w;organism:heron;arm_steem:5p;miRBase_id:her-mir-12;", "K3\t a\t b\t  \t  \t.\t-\t.\tarm_steem:3p;miRBase_id:x;", "8\tm\tS\t5\t9\t.\t+\t.\tarm_steem:3p;miRBase_id:-;"])
    assert rows(text.mirtron_db(mirtron)) == [("chrK3", 2400, 2430, "+", "mirtron", "her-mir-12-5p")]
    base = frame(spark, ["# x", "chrK\t.\tmiRNA_primary_transcript\t1\t9\t.\t+\t.\tID=a;Name=b", "chrK\t.\tmiRNA\t311\t335\t.\t-\t.\tID=a;Alias=a;Name=her-miR-40;Derives_from=b"])
    assert rows(text.mir_base(base)) == [("chrK", 310, 335, "-", "miRNA", "her-miR-40")]
    gtf = frame(spark, ['chrK\tmill\tgene\t901\t978\t.\t-\t.\tgene_id "E"; gene_type "snRNA"; gene_name "Heron5"; level 3;', "chrK\tmill\texon\t1\t2\t.\t+\t.\tx"])
    assert rows(text.gencode(gtf)) == [("chrK", 900, 978, "-", "snRNA", "Heron5")]
    gff3 = frame(spark, ["chrK\tmill\tgene\t2\t9\t.\t-\t.\tID=E;gene_type=snRNA;gene_name=Heron6"])
    assert rows(text.gencode(gff3, "gff3")) == [("chrK", 1, 9, "-", "snRNA", "Heron6")]
    trna = frame(spark, ['chrK\tmill\ttRNA\t5001\t5080\t.\t+\t.\tgene_id "71"; transcript_id "71"; gene_type "Leu_tRNA";'])
    assert rows(text.gencode_trna(trna)) == [("chrK", 5000, 5040, "+", "tRF", "Leu-71-5p"), ("chrK", 5040, 5080, "+", "tRF", "Leu-71-3p")]
    gt = frame(spark, ["chrK\t620\t700\ttRNA-Ser-AGA-3-2\t1000\t-", "chrUn_1\t1\t2\tx\t1\t+"])
    assert rows(text.gtrna_db(gt)) == [("chrK", 620, 660, "-", "tRF", "Ser-AGA_3_2-3p"), ("chrK", 660, 700, "-", "tRF", "Ser-AGA_3_2-5p")]
    with pytest.raises(Exception):
        text.gtrna_db(frame(spark, ["chr1\t1\t2\ttwo-parts\t1\t+"])).collect()


def test_writers(spark, tmp_path):
    fa = spark.createDataFrame([("a b", "ACGT"), ("c", "")], "name string, seq string")
    sinks.write_fasta(fa, str(tmp_path / "o.fa"))
    assert rows(text.read_fasta(spark, str(tmp_path / "o.fa"))) == rows(fa)
    fq = spark.createDataFrame([("a", "ACGT", "@III"), ("c", "G", "+")], "name string, seq string, qual string")
    sinks.write_fastq(fq.coalesce(1), str(tmp_path / "o.fq"))
    streams.register(spark)
    assert rows(spark.read.format("fastq").option("path", str(tmp_path / "o.fq")).load()) == rows(fq)
    sam = spark.createDataFrame([("r", 4, "*", 0, 0, "*", "*", 0, 0, "A", "I", ["NM:i:1", "X:Z:y"]), ("q", 4, "*", 0, 0, "*", "*", 0, 0, "A", "I", [])], __import__("strandloom.schemas", fromlist=["SAM"]).SAM)
    sinks.write_lines(sam.coalesce(1), str(tmp_path / "o.sam"), ["@HD\tVN:1.6", "@CO\tx"])
    assert rows(text.read_sam(spark, str(tmp_path / "o.sam"))) == rows(sam)
    assert text.header(spark, str(tmp_path / "o.sam"), "sam").count() == 2
    assert rows(sinks.delimited(fa, strict_reference=True))[0] == ("a b\tACGT\t",)


def test_reference_round_trip(spark, tmp_path):
    ref = spark.createDataFrame([("chr1", "NNACGTACGTNNNAC"), ("chr2", ""), ("chr3", "ACG"), ("chr4", "N")], "name string, seq string")
    sinks.save_reference(ref, str(tmp_path / "ref"))
    assert rows(sinks.load_reference(spark, str(tmp_path / "ref"))) == rows(ref)


def test_bam(spark, tmp_path):
    from strandloom import schemas

    data = [
        ("r1", 99, "chr1", 101, 60, "5M1I4M", "=", 200, 109, "ACGTNACGTA", "IIIIIIIII#", ["NM:i:-1", "RG:Z:x y", "XA:A:c", "XF:f:1.5", "XB:B:s,1,-2"]),
        ("r2", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "*", []),
        ("r3", 0, "chr2", 1, 3, "3M", "chr1", 5, 0, "ACG", "!~I", []),
    ]
    df = spark.createDataFrame(data * 400, schemas.SAM)
    sinks.write_bam(df.repartition(2), str(tmp_path / "bam"), [("chr1", 1000), ("chr2", 500)])
    got = sources.read(spark, str(tmp_path / "bam" / "*.bam"))
    assert rows(got) == rows(df)
    load = lambda **o: spark.read.format("bam").options(path=str(tmp_path / "bam"), **o).load()
    assert {r.qname for r in load(rname="chr1", begin=105, end=106).collect()} == {"r1"}
    assert load(rname="chr1", begin=200, end=300).count() == 0
    assert {r.qname for r in load(unmapped="true").collect()} == {"r2"}
    assert streams.bam_header(str(next((tmp_path / "bam").glob("*.bam"))))[1] == [("chr1", 1000), ("chr2", 500)]
