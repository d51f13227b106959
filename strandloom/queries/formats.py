"""Queries of readers and writers: records are written as a format has them, read again, and compared with the table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import schemas
from strandloom.queries.registry import Registry, table
from strandloom.sources import sinks, streams, text
from strandloom.storage import shared_dir

REG = Registry()


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_NAMED = "name is not null and seq is not null"


@REG.add("format_fasta", f"select trim(name) as name, regexp_replace(seq, '\\s', '', 'g') as seq from fasta_records where {_NAMED}")
def format_fasta(spark, d):
    where = _place(spark, "fa")
    sinks.write_fasta(table(spark, d, "fasta_records").filter(_NAMED), where)
    return text.read_fasta(spark, where)


@REG.add("format_fastq", "select name, seq, qual from fastq_reads where name is not null and length(seq) = length(qual) and seq <> ''")
def format_fastq(spark, d):
    where = _place(spark, "fq")
    sinks.write_fastq(table(spark, d, "fastq_reads").filter("name is not null and length(seq) = length(qual) and seq <> ''"), where)
    streams.register(spark)
    return spark.read.format("fastq").option("path", where).load()


_SAM = "qname is not null and rname is not null and cigar is not null and rnext is not null and seq is not null and seq <> '' and qual is not null and qual <> '' and flag is not null and pos is not null and mapq is not null and pnext is not null and tlen is not null"
_SHOWN = "qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual"


@REG.add("format_sam", f"select {_SHOWN}, array_to_string(coalesce(optionals, []), ' ') as tags from sam_alignments where {_SAM}")
def format_sam(spark, d):
    where = _place(spark, "sam")
    sinks.write_lines(table(spark, d, "sam_alignments").filter(_SAM).select(*[c.split()[0] for c in schemas.SAM.split(", ")]), where, ["@HD\tVN:1.6"])
    return text.read_sam(spark, where).withColumn("tags", F.array_join("optionals", " ")).drop("optionals")


@REG.add(
    "format_bam",
    f"""select {_SHOWN.replace('seq, qual', "upper(seq) as seq").replace('rnext', "case when rnext = rname and rnext <> '*' then '=' else rnext end as rnext")}, array_to_string(coalesce(optionals, []), ' ') as tags
    from sam_alignments where {_SAM} and pos < 2147483647 and pnext < 2147483647 and flag < 65536 and mapq < 256 and regexp_full_match(rname, '[*]|[!-)+-<>-~][!-~]*')""",
)
def format_bam(spark, d):
    t = table(spark, d, "sam_alignments").filter(_SAM).filter("pos < 2147483647 and pnext < 2147483647 and flag < 65536 and mapq < 256").filter(F.col("rname").rlike(r"\A([*]|[!-)+-<>-~][!-~]*)\z"))
    where = _place(spark, "bam").removeprefix("file://")
    # the header lists the names of chromosomes: bounded by the genome, not by the alignments
    names = [r[0] for r in t.select(F.explode(F.array("rname", "rnext")).alias("n")).filter("n not in ('*', '=')").distinct().orderBy("n").collect()]
    sinks.write_bam(t, where, [(n, 2147483646) for n in names])
    streams.register(spark)
    return spark.read.format("bam").option("path", where).load().withColumn("tags", F.array_join("optionals", " ")).drop("optionals", "qual")


_REGION = "cigar <> '*' and pos > 0 and flag & 4 = 0"


@REG.add(
    "format_bam_region",
    f"""with t as (select * from sam_alignments where {_SAM} and pos < 2147483647 and pnext < 2147483647 and flag < 65536 and mapq < 256 and regexp_full_match(rname, '[*]|[!-)+-<>-~][!-~]*')),
    r as (select rname, min(pos) as low, max(pos) as high from t where {_REGION} group by rname order by count(*) desc, rname limit 1),
    s as (select t.*, t.pos - 1 as b, t.pos - 1 + coalesce(list_sum(list_transform(regexp_extract_all(cigar, '[0-9]+[MDN=X]'), lambda x: x[:-2]::bigint)), 0) as e, low, low + (high - low) // 2 as middle from t join r using (rname))
    select qname, flag, rname, pos, cigar, upper(seq) as seq, case when seq <> '*' and length(qual) = length(seq) then qual else '*' end as qual from s where {_REGION} and b < middle and e > low - 1""",
)
def format_bam_region(spark, d):
    """The lower half of the places of the chromosome with the most alignments, with qualities."""
    t = table(spark, d, "sam_alignments").filter(_SAM).filter("pos < 2147483647 and pnext < 2147483647 and flag < 65536 and mapq < 256").filter(F.col("rname").rlike(r"\A([*]|[!-)+-<>-~][!-~]*)\z"))
    where = _place(spark, "bam").removeprefix("file://")
    names = [r[0] for r in t.select(F.explode(F.array("rname", "rnext")).alias("n")).filter("n not in ('*', '=')").distinct().orderBy("n").collect()]
    qual = F.when((F.col("seq") != "*") & (F.length("qual") == F.length("seq")), F.col("qual")).otherwise("*")
    sinks.write_bam(t.withColumn("qual", qual), where, [(n, 2147483646) for n in names])
    most = t.filter(_REGION).groupBy("rname").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")).orderBy(F.desc("n"), "rname").first()
    streams.register(spark)
    region = spark.read.format("bam").options(path=where, rname=most.rname, begin=most.low - 1, end=most.low + (most.high - most.low) // 2).load()
    return region.filter(_REGION).select("qname", "flag", "rname", "pos", "cigar", "seq", "qual")


_VCF = "chrom is not null and pos is not null and id is not null and ref is not null and alt is not null and qual is not null and filters is not null and info is not null and format_keys is not null"


@REG.add("format_vcf", f"select chrom, pos, id, ref, alt, qual, filters, info, format_keys, array_to_string(samples, ' ') as calls from vcf_variants where {_VCF}")
def format_vcf(spark, d):
    where = _place(spark, "vcf")
    cols = ["chrom", "pos", "id", "ref", "alt", "qual", "filters", "info", "format_keys", "samples"]
    sinks.write_lines(table(spark, d, "vcf_variants").filter(_VCF).select(*cols), where, ["##fileformat=VCFv4.1", "#CHROM\tPOS"])
    return text.read_vcf(spark, where).withColumnsRenamed({"filter": "filters", "format": "format_keys"}).withColumn("calls", F.array_join("samples", " ")).drop("samples")


_BED = "chrom is not null and trim(chrom) <> '' and start_pos is not null and end_pos is not null and name is not null"


@REG.add(
    "format_bed",
    f"""select chrom, start_pos, end_pos, name, coalesce(score, 0) as score, strand, coalesce(thick_start, 0) as thick_start, coalesce(thick_end, 0) as thick_end, item_rgb, coalesce(block_count, 0) as block_count
    from bed_features where {_BED} and strand is not null and item_rgb is not null""",
)
def format_bed(spark, d):
    cols = ["chrom", "start_pos", "end_pos", "name", "score", "strand", "thick_start", "thick_end", "item_rgb", "block_count"]
    lines = sinks.delimited(table(spark, d, "bed_features").filter(_BED + " and strand is not null and item_rgb is not null").select(*cols))
    got = text.records(lines, schemas.BED, text.HEADERS["bed"], text.DEFAULTS["bed"])
    return got.withColumnsRenamed({"start": "start_pos", "end": "end_pos"}).select(*cols)


@REG.add("format_bed_graph", f"select chrom, start_pos, end_pos, round(coalesce(score, 0) / 4.0, 2)::float as value from bed_features where {_BED}")
def format_bed_graph(spark, d):
    lines = sinks.delimited(table(spark, d, "bed_features").filter(_BED).select("chrom", "start_pos", "end_pos", F.coalesce("score", F.lit(0)) / 4.0))
    return text.records(lines, schemas.BED_GRAPH, text.HEADERS["bed"]).select("chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.col("score").alias("value"))


_GENE = "seqid is not null and start_pos is not null and end_pos is not null and start_pos >= 0 and end_pos >= start_pos and strand in ('+', '-') and gene_type is not null and gene_name is not null and trim(seqid) <> ''"
_SIX = "seqid, start_pos, end_pos, strand, gene_type, gene_name"


def _genes(spark, d) -> DataFrame:
    return table(spark, d, "bedsix_genes").filter(_GENE)


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@REG.add("format_bed_six", f"select {_SIX} from bedsix_genes where {_GENE}")
def format_bed_six(spark, d):
    return _shown(text.records(sinks.delimited(_genes(spark, d).select(*_SIX.split(", "))), schemas.BED_SIX))


def _gff_lines(df: DataFrame, kind, attrs, source: str = "X") -> DataFrame:
    return df.select(F.concat_ws("\t", "seqid", F.lit(source), kind, (F.col("start_pos") + 1).cast("string"), F.col("end_pos").cast("string"), F.lit("."), "strand", F.lit("."), attrs).alias("value"))


@REG.add("format_gff", f"select seqid, start_pos + 1 as start_pos, end_pos, 0::float as score, strand, 0 as phase, gene_name from bedsix_genes where {_GENE}")
def format_gff(spark, d):
    lines = _gff_lines(_genes(spark, d), F.lit("gene"), F.concat(F.lit('gene_type "'), "gene_type", F.lit('"; gene_name "'), "gene_name", F.lit('"; level 2;')))
    got = text.with_attributes(text.records(lines, schemas.GFF, text.HEADERS["gff"], text.DEFAULTS["gff"]))
    return _shown(got).select("seqid", "start_pos", "end_pos", "score", "strand", "phase", F.col("attributes")["gene_name"].alias("gene_name"))


@REG.add("annotation_gencode_gtf", f"select {_SIX} from bedsix_genes where {_GENE} and gene_row_id % 3 <> 0")
def annotation_gencode_gtf(spark, d):
    lines = _gff_lines(_genes(spark, d), F.when(F.col("gene_row_id") % 3 != 0, "gene").otherwise("exon"), F.concat(F.lit('gene_id "E"; gene_type "'), "gene_type", F.lit('"; gene_name "'), "gene_name", F.lit('"; level 2;')))
    return _shown(text.gencode(lines))


@REG.add("annotation_gencode_gff3", f"select {_SIX} from bedsix_genes where {_GENE}")
def annotation_gencode_gff3(spark, d):
    lines = _gff_lines(_genes(spark, d), F.lit("gene"), F.concat(F.lit("ID=E;gene_type="), "gene_type", F.lit(";gene_name="), "gene_name", F.lit(";level=2")))
    return _shown(text.gencode(lines, "gff3"))


@REG.add("annotation_mir_base", f"select seqid, start_pos, end_pos, strand, 'miRNA' as gene_type, gene_name from bedsix_genes where {_GENE} and gene_type = 'miRNA'")
def annotation_mir_base(spark, d):
    lines = _gff_lines(_genes(spark, d), F.col("gene_type"), F.concat(F.lit("ID=M;Alias=M;Name="), "gene_name", F.lit(";Derives_from=D")))
    return _shown(text.mir_base(lines))


@REG.add("annotation_mirtron_db", f"select 'chr' || trim(seqid) as seqid, start_pos, end_pos, strand, 'mirtron' as gene_type, gene_name || '-5p' as gene_name from bedsix_genes where {_GENE} and gene_row_id % 5 <> 0")
def annotation_mirtron_db(spark, d):
    name = F.when(F.col("gene_row_id") % 5 != 0, F.col("gene_name")).otherwise("-")
    attrs = F.concat(F.lit(" mirtronDB_id:m;organism:x;arm_steem:5p;miRBase_id:"), name, F.lit(";"))
    t = _genes(spark, d)
    lines = t.select(F.concat_ws(" \t ", "seqid", F.lit("mirtronDB"), F.lit("SO"), (F.col("start_pos") + 1).cast("string"), F.col("end_pos").cast("string"), F.lit("."), "strand", F.lit("."), attrs).alias("value"))
    return _shown(text.mirtron_db(lines))


_HALVES = """select seqid, a as start_pos, z as end_pos, strand, 'tRF' as gene_type, n || case when (strand = '+') = head then '-5p' else '-3p' end as gene_name from
 (select seqid, strand, {} as n, unnest([{{'a': start_pos, 'z': (end_pos - start_pos) // 2 + start_pos, 'head': true}}, {{'a': (end_pos - start_pos) // 2 + start_pos, 'z': end_pos, 'head': false}}], recursive := true) from bedsix_genes where """ + _GENE + ")"


@REG.add("annotation_gencode_trna", _HALVES.format("split_part(gene_type, '_', 1) || '-' || gene_row_id"))
def annotation_gencode_trna(spark, d):
    lines = _gff_lines(_genes(spark, d), F.lit("tRNA"), F.concat(F.lit('gene_id "1"; transcript_id "'), F.col("gene_row_id").cast("string"), F.lit('"; gene_type "'), "gene_type", F.lit('_tRNA";')))
    return _shown(text.gencode_trna(lines))


@REG.add("annotation_gtrna_db", _HALVES.format("gene_type || '-TTC_' || gene_row_id || '_1'"))
def annotation_gtrna_db(spark, d):
    t = _genes(spark, d)
    name = F.concat(F.lit("tRNA-"), "gene_type", F.lit("-TTC-"), F.col("gene_row_id").cast("string"), F.lit("-1"))
    return _shown(text.gtrna_db(t.select(F.concat_ws("\t", "seqid", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), name, F.lit("1000"), "strand").alias("value"))))


@REG.add("format_wig", "select file_name as chrom, line_no::bigint as start_pos, 25 as span, (line_no % 100)::float as value from raw_lines where line_no is not null and file_name is not null")
def format_wig(spark, d):
    """A file of variable steps for each input file, written by one task each as its lines are ordered."""
    t = table(spark, d, "raw_lines").filter("line_no is not null and file_name is not null")
    head = F.concat(F.lit("variableStep chrom="), "file_name", F.lit(" span=25"))
    body = t.select("file_name", F.concat(head, F.lit("\n"), F.col("line_no").cast("string"), F.lit(" "), (F.col("line_no") % 100).cast("string")).alias("value"))
    where = _place(spark, "wig")
    body.select("value").write.text(where)
    streams.register(spark)
    got = spark.read.format("wig").option("path", os.path.join(where, "*.txt")).load()
    return _shown(got).select("chrom", "start_pos", "span", "value")


@REG.add("reference_packed", f"select 'r' || rec_id as name, regexp_replace(upper(regexp_replace(seq, '\\s', '', 'g')), '[^ACGTN]', 'A', 'g') as seq from fasta_records where {_NAMED}")
def reference_packed(spark, d):
    where = _place(spark, "ref")
    t = table(spark, d, "fasta_records").filter(_NAMED).select(F.concat(F.lit("r"), F.col("rec_id").cast("string")).alias("name"), F.upper(F.regexp_replace("seq", r"\s", "")).alias("seq"))
    sinks.save_reference(t, where)
    return sinks.load_reference(spark, where)
