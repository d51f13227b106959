"""Queries of the general data problems: rejected lines, heavy keys, continuous periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import periods, rejects, skew
from strandloom.queries.registry import Registry, table

REG = Registry()


def _judged(spark, d):
    return rejects.judge_lines(table(spark, d, "raw_lines"), table(spark, d, "contig_names"))


#: A field and the rules of values in SQL; a field may be quoted in vcf and bed lines.
_FIELD = """(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*|)"""
_INT = "(regexp_full_match({0}, '[0-9]+') and length(ltrim({0}, '0')) <= 12 and try_cast({0} as hugeint) between {1} and {2})"
_UINT = rejects.UINT32
_JUDGED = f"""with b as (select line_id, file_kind, file_name, line_no, regexp_replace(regexp_replace(line, '\r$', ''), '\t$', '') as body from raw_lines),
 h as (select file_name, file_kind, len(string_split(min_by(body, line_no), chr(9))) as expected from b where file_kind in ('vcf', 'bed') and body like '#%' and body not like '##%' group by all),
 d as (select b.*, expected from b left join h using (file_name, file_kind) where trim(replace(body, chr(9), ' ')) <> ''
   and ((file_kind = 'sam' and body not like '@%') or (file_kind in ('vcf', 'bed') and body not like '#%' and body not like 'track%' and body not like 'browser%'))),
 q as (select *, file_kind = 'sam' or regexp_full_match(body, '{_FIELD}(?:\t{_FIELD})*') as whole,
   case when file_kind = 'sam' then string_split(body, chr(9)) else list_transform(regexp_extract_all(body || chr(9), '{_FIELD}\t'),
     lambda x: case when x like '"%' then replace(x[2:-3], '""', '"') else x[:-2] end) end as f from d),
 c as (select *, case when file_kind = 'sam' then len(f) >= 11 else len(f) = expected end as counted from q),
 s as (select spelling, max(length_bp) as bp from contig_names group by spelling),
 v as (select c.*, bp from c left join s on spelling = case when file_kind = 'sam' then f[3] else f[1] end),
 j as (select line_id, case when not whole then 'quoting' when not counted then 'column_count' when not coalesce(case file_kind
   when 'vcf' then bp is not null and {_INT.format('f[2]', 1, 'bp')} and regexp_full_match(f[4], '[ACGTNacgtn]+') and regexp_full_match(f[6], '[.]|[0-9]+([.][0-9]+)?')
   when 'sam' then {_INT.format('f[2]', 0, 4095)} and (f[3] = '*' or bp is not null) and {_INT.format('f[4]', 0, _UINT)} and {_INT.format('f[5]', 0, 255)}
     and regexp_full_match(f[6], '[*]|([0-9]+[MIDNSHP=X])+') and (f[11] = '*' or (regexp_full_match(f[11], '[!-~]*') and (f[10] = '*' or length(f[10]) = length(f[11]))))
   else bp is not null and {_INT.format('f[2]', 0, _UINT)} and {_INT.format('f[3]', 0, _UINT)} and try_cast(f[3] as hugeint) >= try_cast(f[2] as hugeint)
     and (len(f) < 6 or ({_INT.format('f[5]', 0, 1000)} and f[6] in ('+', '-', '.'))) end, false) then 'value' end as reason from v)
 """


@REG.add("p2_found", _JUDGED + "select distinct line_id, reason from j where reason is not null")
def p2_found(spark, d) -> DataFrame:
    return _judged(spark, d)[1].select("line_id", "reason").distinct()


def _typed(kind: str, columns: str, rest: str = "") -> str:
    """The fields of the valid lines in order as ``name type``, and those behind them in a list."""
    cols = [f"try_cast(f[{i + 1}] as {t}) as {n}" for i, (n, t) in enumerate(c.split() for c in columns.split(", "))]
    if rest:
        cols.append(f"f[{len(cols) + 1}:] as {rest}")
    return _JUDGED + f"select line_id, {', '.join(cols)} from v join j using (line_id) where file_kind = '{kind}' and reason is null"


_VALID = {
    "vcf": _typed("vcf", "chrom varchar, pos bigint, id varchar, ref varchar, alt varchar, qual double, filters varchar, info varchar, format_keys varchar", "samples"),
    "sam": _typed("sam", "qname varchar, flag int, rname varchar, pos bigint, mapq int, cigar varchar, rnext varchar, pnext bigint, tlen int, seq varchar, qual varchar", "optionals"),
    "bed": _typed("bed", "chrom varchar, start_pos bigint, end_pos bigint, name varchar, score int, strand varchar, thick_start bigint, thick_end bigint, item_rgb varchar, block_count int, block_sizes varchar, block_starts varchar"),
}
for _kind, _sql in _VALID.items():
    REG.add(f"p2_valid_{_kind}", _sql)(lambda spark, d, k=_kind: rejects.typed_records(_judged(spark, d)[0], k))

#: Share of a table's rows from which a chromosome counts as heavy.
HEAVY = 0.03
_PLACES = {"vcf_variants": "pos", "bed_features": "start_pos"}


def _statistics(spark, d, name: str) -> DataFrame:
    named = skew.usual_name(F.col("chrom"), table(spark, d, "contig_names"), table(spark, d, name).select("chrom", _PLACES[name]))
    return skew.key_statistics(named, "usual", _PLACES[name])


def _both(spark, d, f) -> DataFrame:
    a, b = (f(_statistics(spark, d, t)).select(F.lit(t).alias("tbl"), "*") for t in _PLACES)
    return a.unionByName(b)


@REG.add(
    "p4_chromosome_stats",
    " union all ".join(
        f"""select '{t}' as tbl, coalesce(c.chrom, nullif(trim(v.chrom), '')) as chrom, count(*) as n_rows,
        count(distinct {p}) as n_positions, quantile_cont({p}, 0.5)::double as median_position
        from {t} v left join contig_names c on trim(v.chrom) = c.spelling group by 1, 2"""
        for t, p in _PLACES.items()
    ),
)
def p4_chromosome_stats(spark, d) -> DataFrame:
    return _both(spark, d, lambda s: s).select("tbl", F.col("k").alias("chrom"), "n_rows", "n_positions", "median_position")


@REG.add(
    "p4_found",
    " union all ".join(
        f"""(select '{t}' as tbl, chrom from (select coalesce(c.chrom, trim(v.chrom)) as chrom, count(*) as n
        from {t} v left join contig_names c on trim(v.chrom) = c.spelling where nullif(trim(v.chrom), '') is not null group by 1)
        where n >= {HEAVY} * (select count(*) from {t} where nullif(trim(chrom), '') is not null))"""
        for t in _PLACES
    ),
)
def p4_found(spark, d) -> DataFrame:
    return _both(spark, d, lambda s: skew.heavy_keys(s, HEAVY)).select("tbl", F.col("k").alias("chrom"))


def _gene_periods(spark, d) -> DataFrame:
    bed = table(spark, d, "bed_features").select("chrom", "start_pos", "end_pos", F.col("name").alias("gene_name"))
    six = table(spark, d, "bedsix_genes").select(F.col("seqid").alias("chrom"), "start_pos", "end_pos", "gene_name")
    named = skew.usual_name(F.col("chrom"), table(spark, d, "contig_names"), bed.unionByName(six))
    return periods.merge_periods(named.drop("chrom").withColumnRenamed("usual", "chrom"), ["chrom", "gene_name"], "start_pos", "end_pos")


_INTERVALS = """with r as (select coalesce(c.chrom, nullif(trim(x.chrom), '')) as chrom, gene_name, s, e from
 (select chrom, name as gene_name, start_pos as s, end_pos as e from bed_features
  union all select seqid, gene_name, start_pos, end_pos from bedsix_genes) x left join contig_names c on trim(x.chrom) = c.spelling
 where s >= 0 and e > s and gene_name is not null and nullif(trim(x.chrom), '') is not null),
 m as (select *, max(e) over (partition by chrom, gene_name order by s, e rows between unbounded preceding and 1 preceding) as reached from r),
 g as (select *, count(*) filter (where reached is null or s > reached) over (partition by chrom, gene_name order by s, e rows unbounded preceding) as no from m),
 p as (select chrom, gene_name, min(s) as period_start, max(e) as period_end from g group by chrom, gene_name, no),
 w as (select *, lead(period_start) over (partition by chrom, gene_name order by period_start) as gap_end from p) """


@REG.add("p6_found", _INTERVALS + "select chrom, gene_name, period_end as gap_start, gap_end from w where gap_end is not null")
def p6_found(spark, d) -> DataFrame:
    return periods.gaps(_gene_periods(spark, d))


@REG.add("p6_periods", _INTERVALS + "select chrom, gene_name, period_start, period_end from w")
def p6_periods(spark, d) -> DataFrame:
    return _gene_periods(spark, d).select("chrom", "gene_name", "period_start", "period_end")
