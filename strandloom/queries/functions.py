"""Queries of the sequence, alignment, quality, interval and mathematical functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import intervals as iv
from strandloom.functions import mathx as mx
from strandloom.functions import quality as ql
from strandloom.functions import sam as sm
from strandloom.functions import seq as sq
from strandloom.queries.registry import Registry, table

REG = Registry()

_READ = "select read_id, upper(regexp_replace(seq, '\\s', '', 'g')) as s from fastq_reads where seq is not null"


def reads(spark, d):
    return table(spark, d, "fastq_reads").filter("seq is not null").select("read_id", F.upper(F.regexp_replace("seq", r"\s", "")).alias("s"), "qual")


def simple(name: str, sql: str, columns):
    """A query of read functions and its SQL; ``columns`` makes them by name when a session is there."""
    REG.add(name, f"with r as ({_READ}) select read_id, {sql} from r")(lambda spark, d: reads(spark, d).select("read_id", *[c.alias(n) for n, c in columns().items()]))


def s():
    return F.col("s")


def _each(f):
    """The values of all letters of a sequence, joined."""
    return F.array_join(F.transform(F.filter(F.split(s(), ""), lambda c: c != ""), lambda c: f(c).cast("string")), "")


def _twelves(f):
    """f of a sequence's pieces of 12 letters, the last one being what is left."""
    return F.when(F.length(s()) > 0, F.transform(F.sequence(F.lit(1), F.length(s()), F.lit(12)), lambda j: f(F.substr(s(), j, F.lit(12))))).otherwise(F.array().cast("array<string>"))


_REVCOMP = "reverse(translate(regexp_replace({}, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"
simple("seq_reverse_complement", _REVCOMP.format("s") + " as rc", lambda: dict(rc=sq.reverse_complement(s())))
simple("seq_codes", "array_to_string(list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: case c when 'A' then 0 when 'C' then 1 when 'G' then 2 when 'T' then 3 else 4 end), '') as codes", lambda: dict(codes=F.array_join(F.transform(sq.codes(s()), lambda c: c.cast("string")), "")))
simple("seq_from_codes", "regexp_replace(s, '[^ACGT]', 'N', 'g') as back", lambda: dict(back=sq.from_codes(sq.codes(s()))))
simple("seq_dna4", "regexp_replace(s, '[^ACGT]', 'A', 'g') as dna4", lambda: dict(dna4=sq.dna4(s())))
simple("seq_first_base", "array_to_string(list_transform(range(1, length(s) + 1), lambda i: case when s[i] in ('A', 'C', 'G', 'T') then 1 else 0 end), '') as valid, array_to_string(list_transform(range(1, length(s) + 1), lambda i: case s[i] when 'A' then 0 when 'C' then 1 when 'G' then 2 when 'T' then 3 else 4 end), '') as code", lambda: dict(valid=_each(lambda c: sq.is_valid(c).cast("int")), code=_each(sq.to_code)))
simple("seq_pack", "array_to_string(list_transform(range(1, length(s) + 1, 12), lambda j: list_reduce(list_transform(string_split(regexp_replace(s[j:j+11], '[^ACGT]', 'A', 'g'), ''), lambda c: case c when 'C' then 1 when 'G' then 2 when 'T' then 3 else 0 end::bigint), lambda a, x: a * 4 + x)), ',') as keys", lambda: dict(keys=F.array_join(_twelves(lambda x: sq.pack(x).cast("string")), ",")))
simple("seq_unpack", "array_to_string(list_transform(range(1, length(s) - 10, 12), lambda j: regexp_replace(s[j:j+11], '[^ACGT]', 'A', 'g')), ',') as words", lambda: dict(words=F.array_join(F.transform(F.filter(_twelves(lambda x: x), lambda x: F.length(x) == 12), lambda x: sq.unpack(sq.pack(x), 12)), ",")))
simple("seq_base_counts", ", ".join(f"(length(s) - length(replace(s, '{b}', ''))) as n_{b.lower()}" for b in "ACGT"), lambda: dict(**{f"n_{b.lower()}": sq.base_count(s(), b) for b in "ACGT"}))
simple("seq_low_complexity", "length(s) > 0 and greatest(" + ", ".join(f"length(s) - length(replace(s, '{b}', ''))" for b in "ACGT") + ") >= 0.3 * length(s) as low", lambda: dict(low=sq.low_complexity(s(), 0.3)))
simple("seq_split_at_unknown", "array_to_string(list_filter(string_split_regex(s, '[^ACGT]+'), lambda x: length(x) >= 19), ',') as parts", lambda: dict(parts=F.array_join(sq.split_at_unknown(s()), ",")))
simple("seq_similarity", "case when length(s) >= 2 then list_sum(list_transform(range(1, length(s) // 2 + 1), lambda i: case when s[i] = s[i + length(s) // 2] then 1 else 0 end)) / (length(s) // 2)::double else 0 end as same", lambda: dict(same=sq.similarity(F.left(s(), F.expr("cast(length(s) div 2 as int)")), F.substr(s(), F.expr("cast(length(s) div 2 + 1 as int)"), F.expr("cast(length(s) div 2 as int)")))))
simple("seq_kmer_hits", f"len(list_filter(list_transform(range(1, length(s) - 6, 7), lambda i: s[i:i+7]), lambda k: contains({_REVCOMP.format('s')}, k)))::int as hits", lambda: dict(hits=sq.kmer_hits(s(), sq.reverse_complement(s()))))
simple("seq_strided_kmers", "case when length(s) >= 8 then array_to_string(list_transform(range(1, length(s) - 6, 7), lambda i: s[i:i+7]), ',') else '' end as words", lambda: dict(words=F.array_join(sq.kmers(s(), 8, 7), ",")))


@REG.add(
    "seq_usable_segments",
    """select read_id, array_to_string(list_filter(string_split_regex(array_to_string(list_transform(range(1, length(seq) + 1),
    lambda i: case when upper(seq[i]) <> 'N' and ascii(qual[i]) >= 43 then seq[i] else ' ' end), ''), ' +'), lambda x: length(x) >= 25), ',') as parts
    from fastq_reads where length(seq) = length(qual) and seq <> ''""",
)
def seq_usable_segments(spark, d):
    t = table(spark, d, "fastq_reads").filter("length(seq) = length(qual) and seq <> ''")
    return t.select("read_id", F.array_join(sq.usable_segments(F.col("seq"), F.col("qual"), 25), ",").alias("parts"))


# CIGAR

_STEPS = "list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda x: {'size': x[:-2]::int, 'op': x[-1]})"
_SIZE = "coalesce(list_sum(list_transform(list_filter(steps, lambda x: contains('{}', x.op)), lambda x: x.size)), 0)::int"
_SAM = f"with a as (select *, {_STEPS} as steps from sam_alignments where cigar is not null) "


def alignments(spark, d):
    return table(spark, d, "sam_alignments").filter("cigar is not null").withColumn("steps", cg.parse(F.col("cigar")))


@REG.add("cigar_sizes", _SAM + f"select aln_id, {_SIZE.format('MDN=X')} as ref_size, {_SIZE.format('MIS=X')} as read_size, {_SIZE.format('SH')} as clip_size, len(steps)::int as n_steps from a")
def cigar_sizes(spark, d):
    s = F.col("steps")
    return alignments(spark, d).select("aln_id", cg.ref_size(s).alias("ref_size"), cg.read_size(s).alias("read_size"), cg.clip_size(s).alias("clip_size"), F.size(s).alias("n_steps"))


@REG.add("cigar_round_trip", "select aln_id, cigar from sam_alignments where cigar is not null")
def cigar_round_trip(spark, d):
    return alignments(spark, d).select("aln_id", cg.show(F.col("steps")).alias("cigar"))


@REG.add("cigar_reverse", _SAM + "select aln_id, case when len(steps) = 0 then '*' else array_to_string(list_transform(list_reverse(steps), lambda x: x.size || x.op), '') end as cigar, list_contains(list_transform(steps, lambda x: x.op), 'S') as clipped from a")
def cigar_reverse(spark, d):
    return alignments(spark, d).select("aln_id", cg.show(cg.reverse(F.col("steps"))).alias("cigar"), cg.contains(F.col("steps"), "S").alias("clipped"))


@REG.add("cigar_compact", "select aln_id, cigar from sam_alignments where cigar is not null")
def cigar_compact(spark, d):
    """Every step is cut in a single base and the rest, and compacted again."""
    cut = F.flatten(F.transform("steps", lambda s: F.filter(F.array(F.struct(F.lit(1).alias("size"), s["op"].alias("op")), F.struct((s["size"] - 1).alias("size"), s["op"].alias("op"))), lambda x: x["size"] > 0)))
    return alignments(spark, d).select("aln_id", cg.show(cg.compact(cut)).alias("cigar"))


# Alignments

@REG.add("sam_flags", "select aln_id, " + ", ".join(f"coalesce(flag & {bit} <> 0, false) as {name}" for name, bit in sm.FLAGS.items()) + " from sam_alignments")
def sam_flags(spark, d):
    return table(spark, d, "sam_alignments").select("aln_id", *[sm.has_flag(F.col("flag"), n).alias(n) for n in sm.FLAGS])


@REG.add("sam_spans", _SAM + f"select aln_id, pos - 1 as begin_at, pos - 1 + {_SIZE.format('MDN=X')} as end_at, pnext - 1 as mate_begin from a")
def sam_spans(spark, d):
    s = F.col("steps")
    return alignments(spark, d).select("aln_id", sm.begin(F.col("pos")).alias("begin_at"), sm.end(F.col("pos"), s).alias("end_at"), sm.mate_begin(F.col("pnext"), F.col("tlen")).alias("mate_begin"))


_PAIRS = """with a as (select distinct on (qname, first_read) * from (select *, coalesce(flag & 64 <> 0, false) as first_read, coalesce(flag & 16 = 0, true) as fwd from sam_alignments
 where flag & 1 <> 0 and flag & 4 = 0 and cigar not in ('*', '') and pos is not null and qname is not null) order by qname, first_read, aln_id),
 z as (select *, """ + _STEPS + """ as steps from a),
 s as (select *, """ + _SIZE.format("MDN=X") + " as rs, " + _SIZE.format("MIS=X") + """ as qs from z),
 p as (select x.aln_id, x.pos <= y.pos as lead_read, least(x.pos, y.pos) as p1, greatest(x.pos, y.pos) as p2,
  case when x.pos <= y.pos then x.fwd else y.fwd end as f1, case when x.pos <= y.pos then y.fwd else x.fwd end as f2,
  case when x.pos <= y.pos then x.rs else y.rs end as r1, case when x.pos <= y.pos then y.rs else x.rs end as r2,
  case when x.pos <= y.pos then x.qs else y.qs end as q1, case when x.pos <= y.pos then y.qs else x.qs end as q2
  from s x join s y on x.qname = y.qname and x.first_read <> y.first_read),
 g as (select *, case when f1 and f2 then p2 + q2 - p1 - q1 when not f1 and not f2 then p2 + r2 - p1 - r1 else p2 - p1 - r1 + 1 end as between_ from p)
 select aln_id, ((case when lead_read then 1 else -1 end) * case when f1 and not f2 then p2 + r2 - p1 else between_ + sign(between_) end)::bigint as tlen from g"""


@REG.add("sam_template_length", _PAIRS)
def sam_template_length(spark, d):
    from strandloom.operators.genome import best_per_place

    t = alignments(spark, d).filter("flag & 1 <> 0 and flag & 4 = 0 and cigar not in ('*', '') and pos is not null and qname is not null")
    t = t.select("aln_id", "qname", "pos", "steps", sm.has_flag(F.col("flag"), "first_of_pair").alias("first_read"), (~sm.has_flag(F.col("flag"), "read_reverse_strand")).alias("fwd"))
    t = best_per_place(t, ["qname", "first_read"], [F.col("aln_id")])
    m = t.select("qname", (~F.col("first_read")).alias("first_read"), F.col("pos").alias("mate_pos"), F.col("steps").alias("mate_steps"), F.col("fwd").alias("mate_fwd"))
    c = F.col
    return t.join(m, ["qname", "first_read"]).select("aln_id", sm.template_length(c("pos"), c("steps"), c("fwd"), c("mate_pos"), c("mate_steps"), c("mate_fwd")).alias("tlen"))


@REG.add("sam_orientation", "select aln_id, case when flag & 16 = 0 then case when flag & 32 = 0 then 'FF' else 'FR' end else case when flag & 32 = 0 then 'RF' else 'RR' end end as orientation from sam_alignments where flag is not null")
def sam_orientation(spark, d):
    t = table(spark, d, "sam_alignments").filter("flag is not null")
    return t.select("aln_id", sm.orientation(~sm.has_flag(F.col("flag"), "read_reverse_strand"), ~sm.has_flag(F.col("flag"), "mate_reverse_strand")).alias("orientation"))


@REG.add(
    "sam_tlen_defined",
    _SAM + f"""select aln_id, coalesce(tlen <> 0 and flag & 1 <> 0 and flag & 12 = 0 and ((flag & 16 <> 0) <> (flag & 32 <> 0))
    and case when flag & 16 <> 0 then pos - 1 + {_SIZE.format('MDN=X')} > pnext else pos - 1 <= pnext - 1 + tlen end, false) as defined from a""",
)
def sam_tlen_defined(spark, d):
    c = F.col
    return alignments(spark, d).select("aln_id", sm.tlen_defined(c("flag"), c("pos"), c("tlen"), c("steps"), c("pnext")).alias("defined"))


@REG.add(
    "sam_hard_clip",
    _SAM + """select aln_id, seq[front + 1 : length(seq) - back] as kept from (select *,
    case when len(steps) > 0 and steps[1].op = 'S' then steps[1].size else 0 end as front, case when len(steps) > 1 and steps[-1].op = 'S' then steps[-1].size else 0 end as back
    from a where seq <> '*' and seq is not null)""",
)
def sam_hard_clip(spark, d):
    t = alignments(spark, d).filter("seq <> '*' and seq is not null")
    return t.select("aln_id", sm.hard_clip(F.col("seq"), F.col("steps")).alias("kept"))


@REG.add(
    "sam_revert_soft_clips",
    _SAM + """select aln_id, case when not rev and front > 0 and pos - 1 >= front then pos - front else pos end as pos,
    seq[case when rev then front else 0 end + 1 : length(seq) - case when rev then 0 else back end] as seq from (select *, coalesce(flag & 16 <> 0, false) as rev,
    case when len(steps) > 0 and steps[1].op = 'S' then steps[1].size else 0 end as front, case when len(steps) > 1 and steps[-1].op = 'S' then steps[-1].size else 0 end as back
    from a where seq not in ('*', '') and pos is not null)""",
)
def sam_revert_soft_clips(spark, d):
    c = F.col
    t = alignments(spark, d).filter("seq not in ('*', '') and pos is not null")
    return t.select("aln_id", sm.revert_soft_clips(c("pos"), c("steps"), c("seq"), c("qual"), sm.has_flag(c("flag"), "read_reverse_strand")).alias("x")).select("aln_id", "x.pos", "x.seq")


@REG.add(
    "sam_clip_to_region",
    """select aln_id, case when least(b + length(seq), e) > greatest(b, r) then seq[greatest(r - b, 0) + 1 : least(b + length(seq), e) - b] else '' end as kept
    from (select aln_id, seq, pos - 1 as b, (pos // 100) * 100 as r, (pos // 100) * 100 + 100 as e from sam_alignments where seq not in ('*', '') and pos is not null)""",
)
def sam_clip_to_region(spark, d):
    t = table(spark, d, "sam_alignments").filter("seq not in ('*', '') and pos is not null").withColumn("r", F.expr("(pos div 100) * 100"))
    return t.select("aln_id", sm.clip_to(F.col("seq"), sm.begin(F.col("pos")), F.col("r"), F.col("r") + 100).alias("kept"))


@REG.add("sam_read_filters", "select aln_id from sam_alignments where not (mapq < 20) and not coalesce(flag & 1024 <> 0, false) and not coalesce(flag & 256 <> 0, false) and not (length(seq) < 10) and not (rnext <> '=') and not (mapq = 0)")
def sam_read_filters(spark, d):
    c = F.col
    drop = [sm.low_mapping_quality(c("mapq")), sm.duplicate(c("flag")), sm.secondary(c("flag")), sm.too_short(c("seq")), sm.mate_elsewhere(c("rnext")), sm.unplaced(c("mapq"))]
    t = table(spark, d, "sam_alignments")
    for x in drop:
        t = t.filter(~x)
    return t.select("aln_id")


@REG.add("sam_gap_penalties", "select aln_id, repeat(chr(73), least(length(seq), 256)) as gap_open, repeat(chr(43), least(length(seq), 256)) as gap_extend from sam_alignments where seq is not null")
def sam_gap_penalties(spark, d):
    n = F.length("seq")
    return table(spark, d, "sam_alignments").filter("seq is not null").select("aln_id", sm.gap_penalties(n, sm.GAP_OPEN).alias("gap_open"), sm.gap_penalties(n, sm.GAP_EXTEND).alias("gap_extend"))


# Qualities

@REG.add("quality_probabilities", """with q as (select read_id, list_transform(string_split(qual, ''), lambda c: ascii(c)) as xs from fastq_reads where qual <> '')
 select read_id, list_sum(list_transform(xs, lambda x: x - 33))::bigint as phred, round(list_sum(list_transform(xs, lambda x: pow(10, (x - 33) / -10.0))), 6) as p, round(list_sum(list_transform(xs, lambda x: pow(10, x / -10.0))), 6) as p_raw,
 round(coalesce(list_sum(list_transform(list_filter(xs, lambda x: x > 33), lambda x: log10(1 - pow(10, (x - 33) / -10.0)))), 0), 6) as log_right from q""")
def quality_probabilities(spark, d):
    """Sums over all bases of each read."""
    letters = F.filter(F.split("qual", ""), lambda c: c != "")
    total = lambda f: F.aggregate(F.transform(letters, f), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    t = table(spark, d, "fastq_reads").filter("qual <> ''")
    return t.select("read_id", total(lambda c: ql.phred(c)).cast("long").alias("phred"), F.round(total(lambda c: ql.error_probability(c)), 6).alias("p"), F.round(total(lambda c: ql.error_probability(c, True)), 6).alias("p_raw"), F.round(total(lambda c: ql.log10_correct_probability(c)), 6).alias("log_right"))


@REG.add("quality_second", "select read_id, list_sort(list_transform(string_split(qual, ''), lambda c: ascii(c)))[2] - 33 as second from fastq_reads where qual <> ''")
def quality_second(spark, d):
    """The second smallest quality of each read."""
    from strandloom.operators.order import second_smallest

    letters = F.filter(F.split("qual", ""), lambda c: c != "")
    return table(spark, d, "fastq_reads").filter("qual <> ''").select("read_id", second_smallest(F.transform(letters, lambda c: ql.phred(c))).alias("second"))


@REG.add("quality_mean", "select read_id, round(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) / length(qual)::double, 6) as mean_quality from fastq_reads where qual <> ''")
def quality_mean(spark, d):
    return table(spark, d, "fastq_reads").filter("qual <> ''").select("read_id", F.round(ql.mean_quality(F.col("qual")), 6).alias("mean_quality"))


@REG.add("quality_trim_end", "select read_id, seq[1:coalesce(list_max(list_filter(range(1, length(qual) + 1), lambda i: ascii(qual[i]) >= 53)), 0)] as kept from fastq_reads where qual is not null and seq is not null")
def quality_trim_end(spark, d):
    return table(spark, d, "fastq_reads").filter("qual is not null and seq is not null").select("read_id", ql.trim_end(F.col("seq"), F.col("qual"), 20).alias("kept"))


@REG.add("quality_blurry", "select read_id, length(regexp_replace(upper(seq), '[ACGT]', '', 'g')) > ceil(0.01 * length(seq)) as blurry from fastq_reads where seq is not null")
def quality_blurry(spark, d):
    return table(spark, d, "fastq_reads").filter("seq is not null").select("read_id", ql.blurry(F.col("seq"), 0.01).alias("blurry"))


# Intervals

_BED = "select feat_id, chrom, start_pos, end_pos, case when strand = '-' then '-' else '+' end as strand from bed_features where chrom is not null and start_pos >= 0 and end_pos >= start_pos"


def bed(spark, d):
    t = table(spark, d, "bed_features").filter("chrom is not null and start_pos >= 0 and end_pos >= start_pos")
    return t.withColumn("iv", iv.interval(F.col("chrom"), F.col("start_pos"), F.col("end_pos"), F.when(F.col("strand") == "-", "-").otherwise("+")))


@REG.add("interval_parse", f"select feat_id, chrom, start_pos as begin_at, end_pos as end_at, strand from ({_BED}) where not contains(chrom, ':')")
def interval_parse(spark, d):
    t = bed(spark, d).filter("not contains(chrom, ':')").select("feat_id", iv.parse(iv.show(F.col("iv"))).alias("x"))
    return t.select("feat_id", "x.chrom", F.col("x.begin").alias("begin_at"), F.col("x.end").alias("end_at"), "x.strand")


@REG.add("interval_measures", f"select feat_id, end_pos - start_pos as size, end_pos = start_pos as empty, strand || chrom || ':' || start_pos || '-' || end_pos as shown, greatest(start_pos - 500, 0) as wide_begin, end_pos + 500 as wide_end from ({_BED})")
def interval_measures(spark, d):
    x = F.col("iv")
    w = iv.expand(x, 500)
    return bed(spark, d).select("feat_id", iv.size(x).alias("size"), iv.is_empty(x).alias("empty"), iv.show(x).alias("shown"), w["begin"].alias("wide_begin"), w["end"].alias("wide_end"))


@REG.add(
    "interval_relations",
    f"""with n as (select *, lead(feat_id) over w as o_id, lead(start_pos) over w as o_start, lead(end_pos) over w as o_end from ({_BED}) window w as (partition by chrom, strand order by start_pos, end_pos, feat_id, strand))
    select feat_id, o_id, start_pos < o_end and o_start < end_pos as overlaps, start_pos <= o_start and end_pos >= o_end as contains, least(start_pos, o_start) as span_begin, greatest(end_pos, o_end) as span_end from n where o_id is not null""",
)
def interval_relations(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("chrom", "iv.strand").orderBy("start_pos", "end_pos", "feat_id")
    t = bed(spark, d).withColumn("o", F.lead("iv").over(w)).withColumn("o_id", F.lead("feat_id").over(w)).filter("o_id is not null")
    a, b = F.col("iv"), F.col("o")
    s = iv.span(a, b)
    return t.select("feat_id", "o_id", iv.overlaps(a, b).alias("overlaps"), iv.contains(a, b).alias("contains"), s["begin"].alias("span_begin"), s["end"].alias("span_end"))


# Mathematics

_V = "select var_id, coalesce(qual, 0) / -10.0 as a, -((var_id % 97) / 7.0) - 0.1 as b from vcf_variants"


def values(spark, d):
    return table(spark, d, "vcf_variants").select("var_id", (F.coalesce("qual", F.lit(0.0)) / -10.0).alias("a"), (-((F.col("var_id") % 97) / 7.0) - 0.1).alias("b"))


@REG.add(
    "math_log_sums",
    f"""select var_id, round(greatest(a, b) + log10(1 + pow(10, least(a, b) - greatest(a, b))), 6) as log_sum,
    round(log10(pow(10, a) + pow(10, b) + pow(10, -1.0)), 6) as log_sum3, round(log10(1 - pow(10, b)), 6) + 0 as log_one_minus, round(ln(1 - exp(b)), 6) as log1mexp, round(b * log10(exp(1)), 6) as as_log10,
    round(greatest(a, b) + case when abs(a - b) < 8 then log10(1 + pow(10, -round(abs(a - b) / 1e-4) * 1e-4)) else 0 end, 6) as near_sum from ({_V})""",
)
def math_log_sums(spark, d):
    a, b = F.col("a"), F.col("b")
    cols = {"log_sum": mx.log10_sum(a, b), "log_sum3": mx.log10_sum_array(F.array(a, b, F.lit(-1.0))), "log_one_minus": mx.log10_one_minus_pow10(b), "log1mexp": mx.log1mexp(b), "as_log10": mx.log_to_log10(b), "near_sum": mx.approximate_log10_sum(a, b)}
    return values(spark, d).select("var_id", *[mx.precision(c, 6).alias(n) for n, c in cols.items()])


_PARTS = "[1.0 + var_id % 5, 2.0 + var_id % 3, 0.5 + var_id % 7]"


@REG.add(
    "math_weights",
    f"""select distinct var_id, round(lgamma(1.0 + var_id % 40) * log10(exp(1)), 6) as log_gamma, round(lgamma(0.25 + var_id % 3) * log10(exp(1)), 6) as log_gamma_small,
    round(list_sum(list_transform({_PARTS}, lambda x: pow(10, -x))), 9) as total, array_to_string(list_transform({_PARTS}, lambda x: round(log10(x / list_sum({_PARTS})), 4)::varchar), ' ') as weights,
    array_to_string(list_transform(range(1, 4), lambda i: ({_PARTS}[i] * [3, 1, 2][i])::int::varchar), '|') as products from vcf_variants""",
)
def math_weights(spark, d):
    n = lambda k: F.col("var_id") % k
    parts = F.array(1.0 + n(5), 2.0 + n(3), 0.5 + n(7))
    shown = F.transform(mx.dirichlet_log10_mean_weights(parts), lambda x: F.round(x, 4).cast("string"))
    products = F.transform(mx.binary_transform(parts, F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), lambda x, y: x * y), lambda x: F.rint(x).cast("int").cast("string"))
    return table(spark, d, "vcf_variants").select(
        "var_id", F.round(mx.log10_gamma(1.0 + n(40)), 6).alias("log_gamma"), F.round(mx.log10_gamma(0.25 + n(3)), 6).alias("log_gamma_small"),
        F.round(mx.sum_log10(F.transform(parts, lambda x: -x)), 9).alias("total"), mx.format_print(shown, " ").alias("weights"), mx.format_print(products, "|").alias("products"),
    ).distinct()


@REG.add(
    "math_normalise",
    f"""with v as ({_V}), t as (select *, log10(pow(10, a) + pow(10, b)) as s, greatest(a, b) as m from v)
    select var_id, round(pow(10, a - s), 6) as pa, round(pow(10, b - s), 6) as pb, round(a - m, 6) as sa, round(b - m, 6) as sb,
    round((m - a) * 10)::int as pla, round((m - b) * 10)::int as plb from t""",
)
def math_normalise(spark, d):
    xs = F.array("a", "b")
    lin, scaled, pl = mx.to_linear(xs), mx.scale_log_array(xs), mx.likelihoods_to_phred(xs)
    return values(spark, d).select("var_id", F.round(lin[0], 6).alias("pa"), F.round(lin[1], 6).alias("pb"), F.round(scaled[0], 6).alias("sa"), F.round(scaled[1], 6).alias("sb"), pl[0].alias("pla"), pl[1].alias("plb"))


@REG.add("math_binomial", "select distinct n, k, round(log10(factorial(n::int)::double), 6) as log_factorial, round(log10(factorial(n::int)::double / factorial(k::int)::double / factorial((n - k)::int)::double), 6) as log_binomial from (select var_id % 13 as n, var_id % 13 // 2 as k from vcf_variants)")
def math_binomial(spark, d):
    t = table(spark, d, "vcf_variants").select((F.col("var_id") % 13).alias("n"), F.expr("(var_id % 13) div 2").alias("k")).distinct()
    return t.select("n", "k", F.round(mx.log10_factorial(F.col("n")), 6).alias("log_factorial"), F.round(mx.log10_binomial(F.col("n"), F.col("k")), 6).alias("log_binomial"))


@REG.add(
    "genotype_order",
    """with n as (select distinct len(string_split(alt, ','))::int + 1 as n from vcf_variants where alt is not null)
    select n, (n * (n + 1) / 2)::int as n_genotypes, n as n_back, array_to_string(flatten(list_transform(range(0, n), lambda b: list_transform(range(0, b + 1), lambda a: a || '|' || b))), ',') as genotypes from n""",
)
def genotype_order(spark, d):
    t = table(spark, d, "vcf_variants").filter("alt is not null").select((F.size(F.split("alt", ",")) + 1).alias("n")).distinct()
    shown = F.array_join(F.transform(mx.genotype_array(F.col("n")), lambda g: F.concat(g["a"].cast("string"), F.lit("|"), g["b"].cast("string"))), ",")
    count = mx.genotype_count(F.col("n"))
    return t.select("n", count.alias("n_genotypes"), mx.allele_count(count).alias("n_back"), shown.alias("genotypes"))


@REG.add(
    "variant_class",
    "select var_id, case when length(ref) = length(a) then 'snp' when length(ref) < length(a) then 'insertion' else 'deletion' end as kind from (select var_id, ref, unnest(string_split(alt, ',')) as a from vcf_variants where ref is not null and alt is not null)",
)
def variant_class(spark, d):
    from strandloom.functions.variant import kind

    return table(spark, d, "vcf_variants").filter("ref is not null and alt is not null").select("var_id", "ref", F.explode(F.split("alt", ",")).alias("a")).select("var_id", kind(F.col("ref"), F.col("a")).alias("kind"))


_MQ = "select aln_id, 100 + aln_id % 51 as score, aln_id % 120 as second, 150::bigint as len, aln_id % 4 as n, (aln_id % 5) / 10.0::double as rep, aln_id % 90 as tail from sam_alignments"


@REG.add(
    "mapq_single",
    f"""with q as (select *, greatest(case when second > 0 then second else 20 end, tail) as rival, (1 - (len - score) / 5.0 / len) as ident from ({_MQ})),
    z as (select *, 3.912 / ln(len) * ident * ident as t from q),
    m as (select *, least(greatest(trunc(6.02 * (score - rival) * t * t + 0.499) - case when n > 0 then trunc(4.343 * ln(n + 1) + 0.499) else 0 end, 0), 60) as best from z)
    select aln_id, case when rival >= score then 0 else trunc(best * (1 - rep) + 0.499) end::int as mapq, trunc(6.02 * (score - second) + 0.499)::int as raw, trunc(pow((score - 550) / 150.0, 2))::int as penalty from m""",
)
def mapq_single(spark, d):
    i = F.col("aln_id")
    score, second = 100 + i % 51, i % 120
    return table(spark, d, "sam_alignments").select("aln_id", mx.mapq_single(score, second, F.lit(150), i % 4, (i % 5) / 10.0, i % 90).alias("mapq"), mx.raw_mapq(score - second).alias("raw"), mx.insert_penalty(score).alias("penalty"))


@REG.add(
    "mapq_pair",
    f"""with q as (select *, least(greatest(trunc(6.02 * (2 * score - greatest(second, tail)) + 0.499) - case when n > 0 then trunc(4.343 * ln(n + 1) + 0.499) else 0 end, 0), 60) as best, aln_id % 61 as se from ({_MQ})),
    p as (select *, trunc(best * (1 - 0.5 * (rep + rep)) + 0.499) as pe from q)
    select aln_id, pe::int as pair_mapq, least(case when se > pe then se else least(pe, se + 40) end, trunc(6.02 * (score - second) + 0.499), 60)::int as own_mapq from p""",
)
def mapq_pair(spark, d):
    i = F.col("aln_id")
    score, second = 100 + i % 51, i % 120
    pair = mx.mapq_pair(2 * score, second, i % 90, i % 4, (i % 5) / 10.0, (i % 5) / 10.0)
    return table(spark, d, "sam_alignments").select("aln_id", pair.alias("pair_mapq"), mx.mapq_in_pair(i % 61, pair, score, second).cast("int").alias("own_mapq"))


@REG.add("array_index_of", "select var_id, (coalesce(nullif(list_position([1, 2, 3, 5], var_id % 7), 0), 5) - 1)::int as at_place from vcf_variants")
def array_index_of(spark, d):
    xs = F.array(*[F.lit(x).cast("long") for x in (1, 2, 3, 5)])
    return table(spark, d, "vcf_variants").select("var_id", mx.index_of(xs, F.col("var_id") % 7).alias("at_place"))
