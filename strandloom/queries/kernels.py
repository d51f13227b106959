"""Queries of the kernel operators over tables derived from the FASTA and FASTQ records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import mathx as mx
from strandloom.functions import seq as sq
from strandloom.kernels import alignment, trimming
from strandloom.operators import genome as gn
from strandloom.operators import kernel_ops as ko
from strandloom.plans import pipe
from strandloom.queries.registry import Registry, table
from strandloom.storage import materialise

REG = Registry()


def contigs(spark, d) -> DataFrame:
    t = table(spark, d, "fasta_records").filter("seq is not null and seq <> ''")
    return t.select(F.concat(F.lit("r"), F.lpad(F.col("rec_id").cast("string"), 9, "0")).alias("name"), F.upper(F.regexp_replace("seq", r"\s", "")).alias("seq"))


def reads(spark, d) -> DataFrame:
    return table(spark, d, "fastq_reads").filter("seq is not null and seq <> ''").select("read_id", F.upper("seq").alias("s"), "qual").distinct()


_UNIT = alignment.Scoring(0, -1, -1, -1)
_READS = "with r as (select distinct read_id, upper(seq) as s, qual from fastq_reads where seq is not null and seq <> '')"


@REG.add("align_global_edits", _READS + " select read_id, -levenshtein(s, s[8:])::bigint as score from r")
def align_global_edits(spark, d):
    """Each whole read with itself from its eighth base on."""
    t = reads(spark, d).select("read_id", "s", F.substr("s", F.lit(8), F.length("s")).alias("b"))
    return ko.align_pairs(t, "read_id", "s", "b", _UNIT, "global").select(F.col("rec_key").alias("read_id"), "score")


@REG.add("align_overhang")
def align_overhang(spark, d):
    """What follows a read's tenth base, with an adapter behind it, against the whole read."""
    t = reads(spark, d).select("read_id", "s", F.concat(F.substr("s", F.lit(11), F.length("s")), F.lit(trimming.ADAPTERS[0])).alias("part"))
    return ko.align_pairs(t, "read_id", "s", "part").select(F.col("rec_key").alias("read_id"), "score", "begin_at", "cigar")


@REG.add("align_local")
def align_local(spark, d):
    t = reads(spark, d).select("read_id", "s", F.concat(F.lit("ACGTACGT"), "s", F.lit("TTTT")).alias("part"))
    return ko.align_pairs(t, "read_id", "s", "part", alignment.STRIPED, "local").select(F.col("rec_key").alias("read_id"), "score", "begin_at", "end_at", "cigar")


@REG.add("suffix_order", _READS + ", x as (select read_id, s, i from r, unnest(range(0, length(s) + 1)) as t(i)) select read_id, row_number() over (partition by read_id order by s[i + 1:] || chr(1)) - 1 as place, i as start_at from x")
def suffix_order(spark, d):
    return ko.suffix_arrays(reads(spark, d), "read_id", "s").withColumnRenamed("rec_key", "read_id")


@REG.add("suffix_order_prefix", _READS + ", x as (select read_id, s, i from r, unnest(range(0, length(s) + 1)) as t(i)) select read_id, row_number() over (partition by read_id order by s[i + 1:i + 4] || chr(1), i) - 1 as place, i as start_at from x")
def suffix_order_prefix(spark, d):
    return ko.suffix_arrays(reads(spark, d), "read_id", "s", 4).withColumnRenamed("rec_key", "read_id")


@REG.add("pairhmm_likelihoods")
def pairhmm_likelihoods(spark, d):
    """Each whole read given its own bases, those with the middle one changed, and with it left out; qualities missing at its end are the lowest."""
    t = reads(spark, d).withColumn("mid", F.expr("cast((length(s) + 1) div 2 as int)"))
    r = t.select(F.col("read_id").alias("region"), F.col("read_id").alias("read"), F.col("s").alias("seq"), F.rpad(F.coalesce("qual", F.lit("")), F.length("s"), F.lit("!")).alias("qual"))
    head, rest = F.left("s", F.col("mid") - 1), F.substr("s", F.col("mid") + 1, F.length("s"))
    ways = F.array(F.col("s"), F.concat(head, F.translate(F.substr("s", "mid", F.lit(1)), "ACGT", "CGTA"), rest), F.concat(head, rest))
    h = t.select(F.col("read_id").alias("region"), F.posexplode(ways).alias("haplotype", "seq"))
    return ko.haplotype_likelihoods(r, h).select("read", "haplotype", F.round("lik", 6).alias("lik"))


@REG.add("poa_consensus")
def poa_consensus(spark, d):
    """The two mates of each template, the reverse one turned."""
    t = table(spark, d, "sam_alignments").filter("seq is not null and seq not in ('', '*') and qname is not null").select("qname", "aln_id", F.upper("seq").alias("seq"), "flag").distinct()
    turned = F.when(F.coalesce(F.col("flag").bitwiseAND(16) != 0, F.lit(False)), sq.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return ko.consensus(t.withColumn("s", turned), "qname", "aln_id", "s").select("cluster", "n_seqs", "consensus")


def _contig_pairs(spark, d) -> DataFrame:
    """Pairs of reads 300 bases apart, every 300 bases of each contig; the reads of the tables come from no contig."""
    c = contigs(spark, d).filter("length(seq) >= 400").withColumn("at", F.explode(F.expr("sequence(1, length(seq) - 399, 300)")))
    q = F.repeat(F.lit("I"), F.lit(100))
    return c.select(F.concat("name", F.lit(":"), F.col("at").cast("string")).alias("name"), F.substr("seq", "at", F.lit(100)).alias("seq1"), q.alias("qual1"), sq.reverse_complement(F.substr("seq", F.col("at") + 300, F.lit(100))).alias("seq2"), q.alias("qual2"))


def _mates(spark, d) -> DataFrame:
    """Mates that two rows of alignments are to each other, as they were sequenced and with their own qualities."""
    t = gn.best_per_place(table(spark, d, "sam_alignments").filter("flag & 1 <> 0"), ["aln_id"], [F.col("loaded_at")]).filter("seq is not null and seq not in ('', '*') and qual is not null")
    back = F.col("flag").bitwiseAND(16) != 0
    t = t.select("aln_id", "flag", "rname", "pos", "pnext", "tlen", F.when(back, sq.reverse_complement(F.upper("seq"))).otherwise(F.upper("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))
    a, b = (t.filter(F.col("flag").bitwiseAND(bit) != 0).select([F.col(c).alias(f"{c}{n}") for c in t.columns]) for n, bit in ((1, 64), (2, 128)))
    met = a.join(b, F.expr("rname1 = rname2 and pnext1 = pos2 and pos1 = pnext2 and tlen1 = -tlen2"))
    return met.select(F.concat(F.lit("a"), F.col("aln_id1").cast("string"), F.lit("-"), F.col("aln_id2").cast("string")).alias("name"), "seq1", "qual1", "seq2", "qual2")


def _pairs(spark, d) -> DataFrame:
    """All reads zipped with their mates by name, a missing mate being empty, and the mates among the alignments."""
    t = table(spark, d, "fastq_reads").filter("seq is not null and seq <> ''").select("read_id", F.coalesce(F.regexp_replace("name", "/[12]$", ""), F.lit("")).alias("stem"), F.coalesce(F.col("name").endswith("/2"), F.lit(False)).alias("second"), F.upper("seq").alias("seq"), F.coalesce("qual", F.lit("")).alias("qual")).distinct()
    # reads of one stem and side stay apart
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("stem", "second").orderBy("read_id", "seq", "qual")))
    a, b = (t.filter(F.col("second") == n).select("stem", "k", *[F.col(c).alias(f"{c}{n + 1}") for c in ("read_id", "seq", "qual")]) for n in (False, True))
    name = F.concat(F.lit("f"), F.coalesce("read_id1", "read_id2").cast("string"))
    zipped = a.join(b, ["stem", "k"], "full").select(name.alias("name"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("seq1", "qual1", "seq2", "qual2")])
    return zipped.unionByName(_mates(spark, d))


@REG.add("map_pairs")
def map_pairs(spark, d):
    rows = _pairs(spark, d).unionByName(_contig_pairs(spark, d)).transform(pipe.align(contigs(spark, d)))
    return rows.select("qname", "flag", "rname", "pos", "mapq", "cigar", "tlen")


@REG.add("map_small_rna")
def map_small_rna(spark, d):
    """All reads, and 25 bases with a tail from every 100 of each contig."""
    body = F.concat(F.substr("seq", "at", F.lit(25)), F.lit("CCA"))
    c = contigs(spark, d).filter("length(seq) >= 25").withColumn("at", F.explode(F.expr("sequence(1, length(seq) - 24, 100)")))
    made = c.select(F.concat("name", F.lit(":"), F.col("at").cast("string")).alias("name"), body.alias("seq"), F.repeat(F.lit("I"), F.lit(28)).alias("qual"))
    r = reads(spark, d).select(F.concat(F.lit("f"), F.col("read_id").cast("string")).alias("name"), F.col("s").alias("seq"), "qual").unionByName(made)
    rows = r.transform(pipe.align_small_rna(contigs(spark, d)))
    return rows.select("qname", "flag", "rname", "pos", "mapq", "cigar")


@REG.add("call_variants")
def call_variants(spark, d):
    """From what is mapped of all pairs, and from reads over one stretch of each contig, half of them with a base changed."""
    c = contigs(spark, d).filter("length(seq) >= 700")
    starts = c.select("name", "seq", F.explode(F.sequence(F.lit(330), F.lit(399), F.lit(4))).alias("at"))
    changed = F.concat(F.left("seq", F.lit(410)), F.translate(F.substr("seq", F.lit(411), F.lit(1)), "ACGTN", "CGTAA"), F.substr("seq", F.lit(412), F.length("seq")))
    body = F.when(F.col("at") % 8 < 4, F.col("seq")).otherwise(changed)
    r = starts.select(
        F.concat("name", F.lit(":"), F.col("at").cast("string")).alias("qname"), F.lit(99).alias("flag"), F.col("name").alias("rname"), (F.col("at") + 1).cast("long").alias("pos"), F.lit(60).alias("mapq"),
        F.lit("100M").alias("cigar"), F.lit("=").alias("rnext"), F.lit(0).cast("long").alias("pnext"), F.lit(0).alias("tlen"), F.substr(body, F.col("at") + 1, F.lit(100)).alias("seq"), F.repeat(F.lit("I"), F.lit(100)).alias("qual"),
    )
    mapped = materialise(_pairs(spark, d).transform(pipe.align(contigs(spark, d))), "mapped")
    called = mapped.select(*r.columns).unionByName(r).transform(pipe.call(contigs(spark, d)))
    return called.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "genotype", F.round("qual", 2).alias("qual"))


def _inserts(spark, d) -> DataFrame:
    """Every read as a whole insert that both mates read through, with its own qualities, and the mates among the alignments."""
    q = F.coalesce("qual", F.lit(""))
    more = [F.repeat(F.lit("I"), F.lit(len(a))) for a in trimming.ADAPTERS]
    through = reads(spark, d).select(
        F.concat(F.lit("f"), F.col("read_id").cast("string")).alias("name"), F.concat("s", F.lit(trimming.ADAPTERS[0])).alias("seq1"), F.concat(q, more[0]).alias("qual1"),
        F.concat(sq.reverse_complement(F.col("s")), F.lit(trimming.ADAPTERS[1])).alias("seq2"), F.concat(F.reverse(q), more[1]).alias("qual2"),
    )
    return through.unionByName(_mates(spark, d))


@REG.add("trim_pairs")
def trim_pairs(spark, d):
    return _inserts(spark, d).transform(lambda p: ko.trim_pairs(p, ko.detect_adapters(p))).select("name", "seq1", "qual1", "seq2", "qual2", "kept")


@REG.add("trim_single")
def trim_single(spark, d):
    """Every whole read with the adapter behind it."""
    t = reads(spark, d).select(F.col("read_id").cast("string").alias("name"), F.concat("s", F.lit(trimming.ADAPTERS[0])).alias("seq"))
    return ko.trim_single(t, "name", trimming.ADAPTERS[0], "seq").withColumnRenamed("rec_key", "name")


@REG.add("allele_frequencies")
def allele_frequencies(spark, d):
    """All alternatives of a variant; the likelihoods fall with its quality, the heterozygous genotypes being the best."""
    t = table(spark, d, "vcf_variants").filter("ref is not null and alt is not null and qual is not null").select("var_id", F.concat(F.array("ref"), F.split("alt", ",")).alias("alleles"), "qual").distinct()
    same = F.transform(mx.genotype_array(F.size("alleles")), lambda g: F.when(g["a"] != g["b"], F.lit(0.0)).when(g["a"] == 0, -F.col("qual") / 10).otherwise(-F.col("qual") / 5))
    return ko.allele_frequencies(t.withColumn("gl", same), "var_id", "gl", "alleles").select(F.col("rec_key").alias("var_id"), F.round("log10_no_variant", 6).alias("log10_no_variant"), F.round(F.col("counts")[1], 6).alias("alt_count"))
