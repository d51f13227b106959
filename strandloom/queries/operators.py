"""Queries of the relational operators: joins, expression matrices, genome-wide statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import mathx as mx
from strandloom.functions import seq as sq
from strandloom.functions.variant import fisher_strand, to_vcf_line
from strandloom.operators import expression as ex
from strandloom.operators import genome as gn
from strandloom.operators import interval_join as ij
from strandloom.operators.skew import usual_name
from strandloom.queries.registry import Registry, table
from strandloom.storage import materialise

REG = Registry()

# Features and positions with the usual names of chromosomes, the latest of rows sent again.
_NAMED = """n as (select spelling, min(chrom) as usual from contig_names group by spelling),
 f as (select feat_id, coalesce(n.usual, trim(b.chrom)) as chrom, start_pos as "begin", end_pos as "end", case when strand = '-' then '-' else '+' end as strand
  from (select distinct on (feat_id) * from bed_features order by feat_id, loaded_at, start_pos, end_pos, chrom) b left join n on trim(b.chrom) = n.spelling where start_pos >= 0 and end_pos >= start_pos and nullif(trim(b.chrom), '') is not null),
 v as (select var_id, coalesce(n.usual, trim(x.chrom)) as chrom, pos - 1 as "begin", pos as "end"
  from (select distinct on (var_id) * from vcf_variants order by var_id, loaded_at, pos, chrom) x left join n on trim(x.chrom) = n.spelling where pos is not null and nullif(trim(x.chrom), '') is not null)"""


def features(spark, d) -> DataFrame:
    t = gn.best_per_place(table(spark, d, "bed_features"), ["feat_id"], [F.col(c) for c in ("loaded_at", "start_pos", "end_pos", "chrom")]).filter("start_pos >= 0 and end_pos >= start_pos")
    t = usual_name(F.col("chrom"), table(spark, d, "contig_names"), t).filter("usual is not null")
    return t.select("feat_id", F.col("usual").alias("chrom"), F.col("start_pos").alias("begin"), F.col("end_pos").alias("end"), F.when(F.col("strand") == "-", "-").otherwise("+").alias("strand"))


def variants(spark, d) -> DataFrame:
    t = gn.best_per_place(table(spark, d, "vcf_variants"), ["var_id"], [F.col(c) for c in ("loaded_at", "pos", "chrom")]).filter("pos is not null")
    t = usual_name(F.col("chrom"), table(spark, d, "contig_names"), t).filter("usual is not null")
    return t.select("var_id", F.col("usual").alias("chrom"), (F.col("pos") - 1).alias("begin"), F.col("pos").alias("end"))


_MEET = 'v.chrom = f.chrom and v."begin" < f."end" and f."begin" < v."end"'


@REG.add("overlap_inner", f"with {_NAMED} select var_id, feat_id from v join f on {_MEET}")
def overlap_inner(spark, d):
    return ij.interval_join(variants(spark, d), features(spark, d), ["chrom"]).select("var_id", F.col("r_feat_id").alias("feat_id"))


@REG.add("overlap_left", f"with {_NAMED} select var_id, feat_id from v left join f on {_MEET}")
def overlap_left(spark, d):
    return ij.interval_join(variants(spark, d), features(spark, d), ["chrom"], "left").select("var_id", F.col("r_feat_id").alias("feat_id"))


@REG.add("overlap_semi", f"with {_NAMED} select var_id from v where exists (select 1 from f where {_MEET})")
def overlap_semi(spark, d):
    return ij.interval_join(variants(spark, d), features(spark, d), ["chrom"], "semi").select("var_id")


@REG.add("overlap_anti", f"with {_NAMED} select var_id from v where not exists (select 1 from f where {_MEET})")
def overlap_anti(spark, d):
    return ij.interval_join(variants(spark, d), features(spark, d), ["chrom"], "anti").select("var_id")


@REG.add("overlap_count", f'with {_NAMED} select f.feat_id, count(o.feat_id) as n_overlaps from f left join f o on f.chrom = o.chrom and f.strand = o.strand and f."begin" < o."end" and o."begin" < f."end" group by f.feat_id')
def overlap_count(spark, d):
    f = features(spark, d)
    return ij.interval_join(f, f, ["chrom", "strand"], "count").select("feat_id", "n_overlaps")


_GENES = """g as (select gene_row_id, coalesce(n.usual, trim(b.seqid)) as chrom, start_pos as "begin", end_pos as "end", gene_name
  from (select distinct on (gene_row_id) * from bedsix_genes order by gene_row_id, loaded_at, start_pos, end_pos, seqid) b left join n on trim(b.seqid) = n.spelling where start_pos >= 0 and end_pos >= start_pos and nullif(trim(b.seqid), '') is not null)"""
_IN = 'g.chrom = f.chrom and f."begin" < g."end" and g."begin" < f."end"'


def genes(spark, d) -> DataFrame:
    t = gn.best_per_place(table(spark, d, "bedsix_genes"), ["gene_row_id"], [F.col(c) for c in ("loaded_at", "start_pos", "end_pos", "seqid")]).filter("start_pos >= 0 and end_pos >= start_pos")
    t = usual_name(F.col("seqid"), table(spark, d, "contig_names"), t).filter("usual is not null")
    return t.select("gene_row_id", F.col("usual").alias("chrom"), F.col("start_pos").alias("begin"), F.col("end_pos").alias("end"), "gene_name")


@REG.add("overlap_genes", f"with {_NAMED}, {_GENES} select feat_id, gene_row_id from f join g on {_IN}")
def overlap_genes(spark, d):
    return ij.interval_join(features(spark, d), genes(spark, d), ["chrom"]).select("feat_id", F.col("r_gene_row_id").alias("gene_row_id"))


@REG.add("overlap_genes_none", f"with {_NAMED}, {_GENES} select feat_id from f where not exists (select 1 from g where {_IN})")
def overlap_genes_none(spark, d):
    return ij.interval_join(features(spark, d), genes(spark, d), ["chrom"], "anti").select("feat_id")


@REG.add("annotation_counts", f"with {_NAMED}, {_GENES}, h as (select feat_id, min(gene_name) as gene, count(*) as n from f join g on {_IN} where gene_name is not null group by feat_id) select 'all' as sample, gene, count(*) as value from h where n = 1 group by gene")
def annotation_counts(spark, d):
    hits = ij.interval_join(features(spark, d), genes(spark, d).filter("gene_name is not null"), ["chrom"])
    return ex.gene_counts(hits.withColumn("sample", F.lit("all")), "feat_id", "r_gene_name", "sample")


@REG.add("unique_annotation", f"with {_NAMED}, h as (select var_id, min(name) as gene, count(*) as n from v join f on {_MEET} join (select distinct on (feat_id) feat_id, name from bed_features order by feat_id, loaded_at, start_pos, end_pos, chrom) using (feat_id) where name is not null group by var_id) select 'all' as sample, gene, count(*) as value from h where n = 1 group by gene")
def unique_annotation(spark, d):
    names = gn.best_per_place(table(spark, d, "bed_features"), ["feat_id"], [F.col(c) for c in ("loaded_at", "start_pos", "end_pos", "chrom")]).select("feat_id", "name")
    hits = ij.interval_join(variants(spark, d), features(spark, d).join(names, "feat_id").filter("name is not null"), ["chrom"])
    return ex.gene_counts(hits.withColumn("sample", F.lit("all")), "var_id", "r_name", "sample")


@REG.add("mate_band_join", """with a as (select distinct on (aln_id) * from sam_alignments order by aln_id, loaded_at)
 select x.aln_id, y.aln_id as mate_id, abs(x.pos - y.pos) as apart from a x join a y on x.qname = y.qname and x.rname = y.rname and x.aln_id < y.aln_id
 and y.pos >= x.pos - 1200 and y.pos < x.pos + 1200 and (x.flag & 16) <> (y.flag & 16)""")
def mate_band_join(spark, d):
    a = gn.best_per_place(table(spark, d, "sam_alignments"), ["aln_id"], [F.col("loaded_at")]).select("aln_id", "qname", "rname", "pos", F.col("flag").bitwiseAND(16).alias("side"))
    p = ij.band_join(a, a, ["qname", "rname"], "pos", "pos", 1200, 1200).filter("aln_id < r_aln_id and side <> r_side")
    return p.select("aln_id", F.col("r_aln_id").alias("mate_id"), F.abs(F.col("pos") - F.col("r_pos")).alias("apart"))


@REG.add("read_pair_zip", """with r as (select distinct read_id, regexp_replace(name, '/[12]$', '') as stem, right(name, 2) as mate from fastq_reads where name like '%/1' or name like '%/2'
 union select aln_id, qname, case when flag & 64 <> 0 then '/1' else '/2' end from sam_alignments where flag & 1 <> 0 and flag & 192 in (64, 128))
 select a.read_id, b.read_id as mate_id from r a join r b on a.stem = b.stem and a.mate = '/1' and b.mate = '/2'""")
def read_pair_zip(spark, d):
    """Mates by name, among the reads and among the alignments."""
    r = table(spark, d, "fastq_reads").filter("name like '%/1' or name like '%/2'").select("read_id", F.regexp_replace("name", "/[12]$", "").alias("stem"), F.right("name", F.lit(2)).alias("mate"))
    a = table(spark, d, "sam_alignments").filter("flag & 1 <> 0 and flag & 192 in (64, 128)").select(F.col("aln_id").alias("read_id"), F.col("qname").alias("stem"), F.when(F.col("flag").bitwiseAND(64) != 0, "/1").otherwise("/2").alias("mate"))
    r = r.unionByName(a).distinct()
    b = r.filter("mate = '/2'").select("stem", F.col("read_id").alias("mate_id"))
    return r.filter("mate = '/1'").join(b, "stem").select("read_id", "mate_id")


_LAID = """c as (select chrom, max(length_bp) as len from contig_names group by chrom), l as (select chrom, sum(len) over (order by chrom) - len as b, sum(len) over (order by chrom) as e from c)"""


@REG.add("chromosome_bounds", f"with {_LAID} select chrom, b::bigint as begin_at, e::bigint as end_at from l")
def chromosome_bounds(spark, d):
    return _bounds(spark, d).select("chrom", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))


def _bounds(spark, d) -> DataFrame:
    c = table(spark, d, "contig_names").groupBy("chrom").agg(F.max("length_bp").alias("len"))
    return gn.chromosome_bounds(c, "chrom", F.col("len"))


@REG.add("position_to_chromosome", f"with {_LAID}, p as (select distinct var_id, pos * 37 as at_pos from vcf_variants where pos is not null) select var_id, chrom, (at_pos - b)::bigint as offset_in from p join l on at_pos >= b and at_pos < e")
def position_to_chromosome(spark, d):
    p = table(spark, d, "vcf_variants").filter("pos is not null").select("var_id", (F.col("pos") * 37).alias("at_pos")).distinct()
    return ij.enclosing_range(p, "at_pos", _bounds(spark, d).select("chrom", "begin", "end"), "begin", "end").select("var_id", "chrom", (F.col("at_pos") - F.col("begin")).alias("offset_in"))


@REG.add("position_intersection", "with f as (select file_kind, list(distinct line_no) as xs from raw_lines group by file_kind) select len(list_intersect(a.xs, b.xs))::int as n_common from f a, f b where a.file_kind = 'vcf' and b.file_kind = 'bed'")
def position_intersection(spark, d):
    t = table(spark, d, "raw_lines").filter("line_no is not null")
    places = t.groupBy("line_no").agg(F.bool_or(F.col("file_kind") == "vcf").alias("a"), F.bool_or(F.col("file_kind") == "bed").alias("b"))
    return places.agg(F.count_if(F.col("a") & F.col("b")).cast("int").alias("n_common"))


# Expression: genes are feature names, samples are strands.

_EXPR = "m as (select coalesce(strand, '.') as sample, gene_type || '/' || gene_name as gene, sum(end_pos - start_pos)::double as value from bedsix_genes where end_pos > start_pos and start_pos >= 0 and gene_name is not null and gene_type is not null group by 1, 2)"
_FILL = _EXPR + ", e as (select s.sample, g.gene, coalesce(m.value, 0) as value from (select distinct sample from m) s cross join (select distinct gene from m) g left join m using (sample, gene))"


def matrix(spark, d) -> DataFrame:
    t = table(spark, d, "bedsix_genes").filter("end_pos > start_pos and start_pos >= 0 and gene_name is not null and gene_type is not null")
    return t.groupBy(F.coalesce("strand", F.lit(".")).alias("sample"), F.concat_ws("/", "gene_type", "gene_name").alias("gene")).agg(F.sum(F.col("end_pos") - F.col("start_pos")).cast("double").alias("value"))


@REG.add("expression_filled", f"with {_FILL} select * from e")
def expression_filled(spark, d):
    return ex.filled(matrix(spark, d))


@REG.add("expression_size_normalised", f"with {_EXPR} select sample, gene, round(value / sum(value) over (partition by sample), 9) as value from m")
def expression_size_normalised(spark, d):
    return ex.size_normalised(matrix(spark, d)).withColumn("value", F.round("value", 9))


@REG.add("expression_quantile_normalised", f"with {_FILL}, r as (select *, row_number() over (partition by sample order by value, gene) as k from e), a as (select *, avg(value) over (partition by k) as mean from r) select sample, gene, value, round(avg(mean) over (partition by sample, value), 6) as normalised from a")
def expression_quantile_normalised(spark, d):
    return ex.quantile_normalised(matrix(spark, d)).withColumn("normalised", F.round("normalised", 6))


_TMM = _FILL + """, s as (select sample, sum(value) as n, quantile_cont(value, 0.75) / sum(value) as q from e group by sample),
 ref as (select sample as ref from s order by abs(q - (select avg(q) from s)), sample limit 1),
 b as (select x.sample, x.gene, x.value as o, sx.n as no, y.value as r, sy.n as nr from e x join s sx using (sample) join ref on true join e y on y.sample = ref.ref and y.gene = x.gene join s sy on sy.sample = ref.ref where x.value > 0 and y.value > 0),
 z as (select sample, gene, log2((o / no) / (r / nr)) as m, (log2(o / no) + log2(r / nr)) / 2 as a, (no - o) / no / o + (nr - r) / nr / r as v from b),
 k as (select *, count(*) over w as n, row_number() over (partition by sample order by m, gene) - 1 as rm, row_number() over (partition by sample order by a, gene) - 1 as ra, max(abs(m)) over w as far from z where a > -1e10 window w as (partition by sample)),
 g as (select sample, pow(2, sum(m / v) / sum(1 / v)) as raw from k where rm >= floor(n * 0.3) and rm < n - floor(n * 0.3) and ra >= floor(n * 0.05) and ra < n - floor(n * 0.05) and far >= 1e-6 group by sample),
 t as (select sample, coalesce(raw, 1) as raw from s left join g using (sample))"""


@REG.add("expression_tmm_factors", f"with {_TMM} select sample, round(raw, 6) as raw, round(raw / pow(2, (select avg(log2(raw)) from t)), 6) as factor from t")
def expression_tmm_factors(spark, d):
    return ex.tmm_factors(matrix(spark, d)).select("sample", F.round("raw", 6).alias("raw"), F.round("factor", 6).alias("factor"))


@REG.add("expression_tmm_reference", f"with {_TMM} select ref as sample from ref")
def expression_tmm_reference(spark, d):
    return ex.tmm_reference(ex.filled(matrix(spark, d)))


@REG.add("expression_tmm_normalised", f"with {_TMM} select sample, gene, round(value / (raw / pow(2, (select avg(log2(raw)) from t))), 4) as value from e join t using (sample)")
def expression_tmm_normalised(spark, d):
    return ex.tmm_normalised(matrix(spark, d)).withColumn("value", F.round("value", 4))


_TAILED = """with r as (select library as gene, upper(seq) as seq, case when read_id % 3 = 0 and length(seq) > 30 then length(seq) - read_id % 5 - 1 else -1 end as tail_pos, read_id % 4 as hits from fastq_reads where seq is not null and seq <> '' and library is not null),
 c as (select gene, seq[tail_pos + 1:] as tail, tail_pos >= 0 as has, case when tail_pos >= 0 then tail_pos else length(seq) end::int as read_len, 1.0 / hits as value from r where hits > 0),
 t as (select gene, case when not has then 5 when regexp_matches(tail, '^A+$') then 0 when regexp_matches(tail, '^C+$') then 1 when regexp_matches(tail, '^G+$') then 2 when regexp_matches(tail, '^(T+|U+)$') then 3 else 4 end as tail_idx, read_len, sum(value)::double as value from c group by all) """


def tailed(spark, d) -> DataFrame:
    t = table(spark, d, "fastq_reads").filter("seq is not null and seq <> '' and library is not null")
    tail = F.when((F.col("read_id") % 3 == 0) & (F.length("seq") > 30), F.length("seq") - F.col("read_id") % 5 - 1).otherwise(-1).cast("int")
    t = t.select(F.col("library").alias("gene"), F.upper("seq").alias("seq"), tail.alias("tail_pos"), (F.col("read_id") % 4).alias("hits"))
    return ex.tailed_expression(t, "gene", "seq", "tail_pos", "hits")


@REG.add("expression_tailed", _TAILED + "select gene, tail_idx, read_len, round(value, 6) as value from t")
def expression_tailed(spark, d):
    return tailed(spark, d).withColumn("value", F.round("value", 6))


@REG.add("expression_by_length", _TAILED + "select gene, read_len, " + ", ".join(f"round(coalesce(sum(value) filter (where tail_idx = {i}), 0), 6) as tail_{i}" for i in range(6)) + " from t group by gene, read_len")
def expression_by_length(spark, d):
    return ex.by_length(tailed(spark, d)).select("gene", "read_len", *[F.round(f"tail_{i}", 6).alias(f"tail_{i}") for i in range(6)])


@REG.add("expression_tailed_sum", _TAILED + "select gene, round(coalesce(sum(value) filter (where tail_idx < 5), 0), 4) as value from t group by gene")
def expression_tailed_sum(spark, d):
    return ex.tailed_sum(tailed(spark, d)).withColumn("value", F.round("value", 4))


@REG.add("expression_add_scale", f"with {_EXPR} select sample, gene, round(value + value * 0.5, 6) as value from m")
def expression_add_scale(spark, d):
    m = matrix(spark, d)
    return ex.add(m, ex.scale(m, 0.5), ["sample", "gene"]).withColumn("value", F.round("value", 6))


# Genome-wide

_FASTA = "select rec_id, upper(regexp_replace(seq, '\\s', '', 'g')) as s from fasta_records where seq is not null"


def fasta(spark, d) -> DataFrame:
    return table(spark, d, "fasta_records").filter("seq is not null").select("rec_id", F.upper(F.regexp_replace("seq", r"\s", "")).alias("s"))


@REG.add("reference_base_counts", f"with f as ({_FASTA}), c as (select " + ", ".join(f"sum(length(s) - length(replace(s, '{b}', ''))) as {b}" for b in "ACGT") + ", sum(length(s)) as al from f) " + " union all ".join([f"select '{b}' as base, {b}::bigint as n from c" for b in "ACGT"] + ["select 'N', (al - A - C - G - T)::bigint from c"]))
def reference_base_counts(spark, d):
    return gn.base_counts(table(spark, d, "fasta_records"), "seq")


@REG.add("reference_unknown_runs", f"with f as ({_FASTA}), p as (select rec_id, unnest(range(1, length(s) + 1)) as i, s from f), n as (select rec_id, i from p where s[i] = 'N'), g as (select *, i - row_number() over (partition by rec_id order by i) as no from n) select rec_id, min(i) - 1 as begin_at, max(i) as end_at from g group by rec_id, no")
def reference_unknown_runs(spark, d):
    return gn.unknown_runs(table(spark, d, "fasta_records"), "rec_id", "seq").select(F.col("rec_key").alias("rec_id"), F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))


@REG.add("reference_restored", "select rec_id, upper(regexp_replace(seq, '\\s', '', 'g')) as s from fasta_records where seq is not null")
def reference_restored(spark, d):
    """N is replaced as a reference load does, and written back from its runs."""
    runs = gn.unknown_runs(table(spark, d, "fasta_records"), "rec_id", "seq").groupBy("rec_key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))
    f = fasta(spark, d).withColumn("s", F.translate("s", "N", "A"))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return f.join(runs, F.col("rec_id") == F.col("rec_key"), "left").select("rec_id", sq.with_runs(F.col("s"), F.coalesce("runs", none)).alias("s"))


@REG.add("genome_tiles", "select distinct aln_id, t as tile from sam_alignments, unnest(range(greatest(0, (pos - 1) // 100 - 2), (pos - 1) // 100 + 1)) as x(t) where pos > 0")
def genome_tiles(spark, d):
    t = table(spark, d, "sam_alignments").filter("pos > 0").select("aln_id", (F.col("pos") - 1).alias("begin")).distinct()
    return gn.tiles(t, "begin").select("aln_id", "tile")


@REG.add("reads_per_start", "select aln_id from (select aln_id, row_number() over (partition by rname, pos // 100000 order by md5(qname), aln_id) as k from (select distinct aln_id, rname, pos, qname from sam_alignments where pos is not null and qname is not null)) where k <= 5")
def reads_per_start(spark, d):
    t = table(spark, d, "sam_alignments").filter("pos is not null and qname is not null").select("aln_id", "rname", F.expr("pos div 100000").alias("place"), F.md5("qname").alias("h")).distinct()
    return gn.sampled(t, ["rname", "place"], F.struct("h", "aln_id"), 5).select("aln_id")


_KMERS = f"with f as ({_FASTA}), k as (select rec_id, s[i:i+{{}}] as w from f, unnest(range(1, length(s) - {{}})) as x(i)) "


@REG.add("kmer_counts", _KMERS.format(7, 6) + "select w as kmer, count(*) as n from k group by w")
def kmer_counts(spark, d):
    return gn.kmer_counts(fasta(spark, d), F.col("s"), 8)


@REG.add("kmer_edges", _KMERS.format(7, 6) + "select w[1:7] as source, w[2:8] as target, count(*) as n from k group by 1, 2")
def kmer_edges(spark, d):
    return gn.edge_counts(fasta(spark, d), F.col("s"), 7)


@REG.add("kmer_repeated", _KMERS.format(9, 8) + "select distinct w as kmer from (select rec_id, w from k group by all having count(*) > 1)")
def kmer_repeated(spark, d):
    return gn.repeated_kmers(fasta(spark, d), "rec_id", F.col("s"), 10)


@REG.add("seed_positions", f"""with f as ({_FASTA}), k as (select rec_id, i - 1 as place, s[i:i+18] as w from f, unnest(range(1, length(s) - 17)) as x(i)),
 q as (select 'read ' || read_id as query, upper(seq) as s from fastq_reads where seq is not null union select 'record ' || rec_id, s from f),
 r as (select query, i - 1 as query_at, s[i:i+18] as w from q, unnest(range(1, length(s) - 17, 19)) as x(i))
 select query, query_at::int as query_at, rec_id, place::int as place from r join k using (w) where query <> 'record ' || rec_id""")
def seed_positions(spark, d):
    """Exact seeds of all reads and records in the records, at every 19th base, by a posting table of 19-mers: hash partitioned and never broadcast."""
    posting = gn.kmer_places(fasta(spark, d), "rec_id", F.col("s"), 19).select(F.col("rec_key").alias("rec_id"), F.col("place").cast("int").alias("place"), F.col("kmer").alias("w"))
    reads = table(spark, d, "fastq_reads").filter("seq is not null").select(F.concat(F.lit("read "), F.col("read_id").cast("string")).alias("query"), F.upper("seq").alias("s")).distinct()
    records = fasta(spark, d).select(F.concat(F.lit("record "), F.col("rec_id").cast("string")).alias("query"), "s")
    seeds = gn.kmer_places(reads.unionByName(records), "query", F.col("s"), 19).filter("place % 19 = 0").select(F.col("rec_key").alias("query"), F.col("place").cast("int").alias("query_at"), F.col("kmer").alias("w"))
    return seeds.join(posting, "w").filter(F.col("query") != F.concat(F.lit("record "), F.col("rec_id").cast("string"))).select("query", "query_at", "rec_id", "place")


_SCORES = "select distinct aln_id % 500 as read, coalesce(mapq, 0)::int as score, aln_id from sam_alignments"


def scores(spark, d) -> DataFrame:
    return table(spark, d, "sam_alignments").select((F.col("aln_id") % 500).alias("read"), F.coalesce("mapq", F.lit(0)).cast("int").alias("score"), "aln_id").distinct()


@REG.add("alignment_score_band", f"select read, aln_id from (select *, max(score) over (partition by read) as top from ({_SCORES})) where score >= top - 30")
def alignment_score_band(spark, d):
    return gn.score_band(scores(spark, d), ["read"], "score").select("read", "aln_id")


@REG.add("alignment_score_summary", f"with s as (select *, row_number() over (partition by read order by score desc) as k from ({_SCORES})), x as (select read, max(score) as best, max(score) filter (where k = 2) as second from s group by read) select s.read, any_value(best) as best, coalesce(any_value(second), 0) as second, count(*) filter (where k > 1 and score >= second - 5) as n_second from s join x using (read) group by s.read")
def alignment_score_summary(spark, d):
    return gn.score_summary(scores(spark, d), ["read"], "score")


@REG.add("alignment_best_per_place", "select aln_id from (select aln_id, row_number() over (partition by rname, pos, flag & 16 order by mapq desc nulls last, aln_id) as k from (select distinct aln_id, rname, pos, flag, mapq from sam_alignments)) where k = 1")
def alignment_best_per_place(spark, d):
    t = table(spark, d, "sam_alignments").select("aln_id", "rname", "pos", F.col("flag").bitwiseAND(16).alias("side"), "mapq").distinct()
    return gn.best_per_place(t, ["rname", "pos", "side"], [F.col("mapq").desc_nulls_last(), F.col("aln_id")]).select("aln_id")


@REG.add("record_order", "select aln_id, row_number() over (order by rname nulls first, pos nulls first, aln_id) as place from (select distinct aln_id, rname, pos from sam_alignments)")
def record_order(spark, d):
    from strandloom.operators.order import ranked

    return ranked(table(spark, d, "sam_alignments").select("aln_id", "rname", "pos").distinct(), ["rname", "pos", "aln_id"], "place").select("aln_id", "place")


@REG.add("variant_consensus", """with r as (select distinct on (chrom) 'c' || (rec_id % 40) as chrom, upper(regexp_replace(seq, '\\s', '', 'g')) as seq from fasta_records where length(seq) > 200 order by chrom, rec_id),
 v as (select 'c' || (var_id % 40) as chrom, 40 * (var_id // 40 % 4) + 1 as pos, min(upper(ref) || '>' || string_split(alt, ',')[1]) as x from vcf_variants where ref is not null and alt is not null group by 1, 2),
 w as (select chrom, list(x order by pos) as xs, list(pos order by pos) as ps from v group by chrom)
 select chrom, case when xs is null then seq else array_to_string(list_transform(range(1, len(xs) + 1), lambda i: replace(string_split(xs[i], '>')[2], '.', '') || seq[ps[i] + length(string_split(xs[i], '>')[1]) : coalesce(ps[i + 1] - 1, length(seq))]), '') end as seq from r left join w using (chrom)""")
def variant_consensus(spark, d):
    f = table(spark, d, "fasta_records").filter("length(seq) > 200").select("rec_id", F.concat(F.lit("c"), (F.col("rec_id") % 40).cast("string")).alias("chrom"), F.upper(F.regexp_replace("seq", r"\s", "")).alias("seq"))
    v = table(spark, d, "vcf_variants").filter("ref is not null and alt is not null")
    place = F.expr("40 * (var_id div 40 % 4) + 1")
    v = v.groupBy(F.concat(F.lit("c"), (F.col("var_id") % 40).cast("string")).alias("chrom"), place.alias("pos")).agg(F.min(F.concat(F.upper("ref"), F.lit(">"), F.split("alt", ",")[0])).alias("x"))
    v = v.select("chrom", "pos", F.split("x", ">")[0].alias("ref"), F.split("x", ">")[1].alias("alt"))
    return gn.consensus(gn.best_per_place(f, ["chrom"], [F.col("rec_id")]), v)


def _laid(spark, d) -> DataFrame:
    """``chrom, seq, length_bp, n_bases``: every record laid end to end on the usual chromosomes in turn (records name none of them)."""
    names = table(spark, d, "contig_names").groupBy(F.col("chrom").alias("usual")).agg(F.max("length_bp").alias("length_bp"))
    numbered = names.withColumn("k", F.row_number().over(Window.orderBy("usual")) - 1)
    f = fasta(spark, d).filter("s <> ''").withColumn("k", F.pmod(F.col("rec_id"), names.agg(F.count(F.lit(1))).scalar()))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_id", "s"))), lambda x: x["s"]), "")
    laid = f.groupBy("k").agg(text.alias("seq"))
    return laid.join(numbered, "k").select(F.col("usual").alias("chrom"), "seq", "length_bp", F.length("seq").cast("long").alias("n_bases"))


@REG.add("variant_consensus_whole")
def variant_consensus_whole(spark, d):
    """Every variant of a known chromosome in all records; positions are scaled from the chromosome's length to the bases laid on it."""
    t = gn.best_per_place(table(spark, d, "vcf_variants"), ["var_id"], [F.col(c) for c in ("loaded_at", "pos", "chrom", "ref", "alt")]).filter("pos is not null")
    t = usual_name(F.col("chrom"), table(spark, d, "contig_names"), t).select(F.col("usual").alias("chrom"), F.col("pos").alias("at"), F.upper("ref").alias("ref"), "alt")
    laid = materialise(_laid(spark, d), "laid")
    v = t.join(laid.select("chrom", "length_bp", "n_bases"), "chrom").select("chrom", F.expr("(at - 1) * n_bases div length_bp + 1").alias("pos"), "ref", "alt")
    return gn.consensus(laid.select("chrom", "seq"), v)


# Genotyping aggregates

_LIK = "l as (select distinct aln_id as read, k as allele, -((aln_id * (k + 3)) % 17) / 5.0::double as lik, aln_id % 200 as locus from sam_alignments, unnest([0, 1, 2]) as x(k))"


def likelihoods(spark, d) -> DataFrame:
    t = table(spark, d, "sam_alignments").select(F.col("aln_id").alias("read"), (F.col("aln_id") % 200).alias("locus")).distinct()
    t = t.withColumn("allele", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return t.withColumn("lik", -((F.col("read") * (F.col("allele") + 3)) % 17) / 5.0)


@REG.add("genotype_depths", f"with {_LIK}, r as (select *, row_number() over (partition by read order by lik desc, allele) as k, max(lik) over (partition by read) as best from l), s as (select read, max(lik) as second from r where k > 1 group by read) select locus, allele, count(*) as depth from r join s using (read) where k = 1 and best - second > 0.2 group by locus, allele")
def genotype_depths(spark, d):
    from strandloom.operators import genotyping as gt

    return gt.depth_per_allele(likelihoods(spark, d), ["locus"], "read", "allele", "lik")


@REG.add("genotype_likelihoods", f"with {_LIK} select x.locus, x.allele as a, y.allele as b, round(sum(greatest(x.lik, y.lik) + log10(1 + pow(10, least(x.lik, y.lik) - greatest(x.lik, y.lik))) - log10(2)), 4) as lik from l x join l y on x.read = y.read and x.allele <= y.allele group by 1, 2, 3")
def genotype_likelihoods(spark, d):
    from strandloom.operators import genotyping as gt

    return gt.genotype_likelihoods(likelihoods(spark, d), ["locus"], "read", "allele", "lik").withColumn("lik", F.round("lik", 4))


@REG.add("haplotype_marginals", f"with {_LIK} select read, allele % 2 as grp, max(lik) as lik from l group by 1, 2")
def haplotype_marginals(spark, d):
    from strandloom.operators import genotyping as gt

    return gt.marginalised(likelihoods(spark, d).withColumn("grp", F.col("allele") % 2), "read", "grp", "lik")


@REG.add("log_sum_aggregate", f"with {_LIK}, m as (select locus, lik, max(lik) over (partition by locus) as top from l) select locus, round(any_value(top) + log10(sum(pow(10, lik - top))), 6) as total from m group by locus")
def log_sum_aggregate(spark, d):
    from strandloom.operators import genotyping as gt

    return gt.log10_sum(likelihoods(spark, d), ["locus"], "lik").select("locus", F.round("total", 6).alias("total"))


@REG.add("fisher_strand", """with t as (select distinct var_id % 29 as a, var_id % 17 as b, var_id % 23 as c, var_id % 13 as d from vcf_variants),
 p as (select *, unnest(range(greatest(0, (a + c) + (c + d) - (a + b + c + d)), least(a + c, c + d) + 1)) as k from t),
 q as (select *, exp(lgamma(a + c + 1) - case when k = 0 then 0 else lgamma(k + 1) end - lgamma(a + c - k + 1) + lgamma(b + d + 1) - lgamma(c + d - k + 1) - lgamma(b + d - c - d + k + 1)
   - lgamma(a + b + c + d + 1) + lgamma(c + d + 1) + lgamma(a + b + 1)) as pr from p),
 o as (select a, b, c, d, any_value(pr) as own from q where k = c group by all)
 select a, b, c, d, round(abs(-10 * log10(least(1, sum(pr)))), 4) as fs from q join o using (a, b, c, d) where pr <= own * (1 + 1e-9) group by all""")
def fisher_query(spark, d):
    t = table(spark, d, "vcf_variants").select(*[(F.col("var_id") % n).alias(x) for n, x in ((29, "a"), (17, "b"), (23, "c"), (13, "d"))]).distinct()
    return t.select("a", "b", "c", "d", F.round(fisher_strand("a", "b", "c", "d"), 4).alias("fs"))


@REG.add("variant_vcf_line", "select distinct var_id, concat_ws(chr(9), chrom, pos::varchar, '.', ref, alt, '50', '.', '.', 'GT:GQ:PL', '0|1:30:0,30,60') as line from vcf_variants where chrom is not null and pos is not null and ref is not null and alt is not null")
def variant_vcf_line(spark, d):
    t = table(spark, d, "vcf_variants").filter("chrom is not null and pos is not null and ref is not null and alt is not null")
    line = to_vcf_line(F.col("chrom"), F.col("pos") - 1, F.col("ref"), F.split("alt", ","), F.lit(50), F.lit("0|1"), F.lit(30), F.array(F.lit(0), F.lit(30), F.lit(60)))
    return t.select("var_id", line.alias("line")).distinct()


@REG.add("mismatch_distances", "with r as (select distinct read_id, list_filter(range(1, length(seq) + 1), lambda i: upper(seq)[i] = 'A') as xs from fastq_reads where seq <> '') select read_id, array_to_string(list_transform(range(1, len(xs) + 1), lambda i: xs[i] - coalesce(xs[i - 1], 0)), ',') as steps from r")
def mismatch_distances(spark, d):
    from strandloom.operators.order import differences

    t = table(spark, d, "fastq_reads").filter("seq <> ''").select("read_id", F.filter(F.sequence(F.lit(1), F.length("seq")), lambda i: F.substr(F.upper("seq"), i, F.lit(1)) == "A").alias("xs")).distinct()
    return t.select("read_id", F.array_join(F.transform(differences(F.col("xs")), lambda x: x.cast("string")), ",").alias("steps"))


@REG.add(
    "reference_confidence",
    """with p as (select library, upper(seq)[i] as b, ascii(qual[i]) - 33 as q, case when read_id % 2 = 0 then 'A' else upper(seq)[i + 1] end as ref from fastq_reads, unnest(range(1, least(length(seq) - 1, length(qual)) + 1)) as x(i)),
    l as (select *, b = ref as same, log10(1 - pow(10, -q / 10.0)) as yes, -q / 10.0 - log10(3) as no from p where q > 0 and library is not null),
    x as (select library, case when same then yes else no end as r, case when same then no else yes end as a from l)
    select library, count(*) as depth, round(sum(r), 4) as hom_ref, round(sum(greatest(r, a) + log10(1 + pow(10, least(r, a) - greatest(r, a))) - log10(2)), 4) as het, round(sum(a), 4) as hom_alt from x group by library""",
)
def reference_confidence(spark, d):
    from strandloom.operators import genotyping as gt

    t = table(spark, d, "fastq_reads").filter("length(seq) >= 2 and qual <> '' and library is not null")
    t = t.select("library", "read_id", F.upper("seq").alias("s"), "qual", F.explode(F.sequence(F.lit(1), F.least(F.length("seq") - 1, F.length("qual")))).alias("i"))
    at = lambda c, i: F.substr(c, i, F.lit(1))
    t = t.select("library", at("s", F.col("i")).alias("b"), (F.ascii(at("qual", F.col("i"))) - 33).alias("q"), F.when(F.col("read_id") % 2 == 0, "A").otherwise(at("s", F.col("i") + 1)).alias("ref"))
    return gt.reference_confidence(t, ["library"], "b", "q", "ref").select("library", "depth", *[F.round(c, 4).alias(c) for c in ("hom_ref", "het", "hom_alt")])


@REG.add("genotype_vcf_order", "select distinct var_id, array_to_string([var_id % 11, var_id % 7, var_id % 3, var_id % 5, var_id % 13, var_id % 2], ',') as shown from vcf_variants")
def genotype_vcf_order(spark, d):
    """The same values given by the smaller allele: 00 01 02 11 12 22."""
    v = lambda n: F.col("var_id") % n
    xs = mx.to_vcf_order(F.array(v(11), v(7), v(5), v(3), v(13), v(2)), 3)
    return table(spark, d, "vcf_variants").select("var_id", F.array_join(F.transform(xs, lambda x: x.cast("string")), ",").alias("shown")).distinct()
