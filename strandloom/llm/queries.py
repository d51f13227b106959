"""Queries of the problems solved in this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import leaks, mixing, neardup, pieces, sentences, shared_spans
from strandloom.queries.registry import Registry, table
from strandloom.storage import materialise

REG = Registry()


def _pieces(spark, d) -> DataFrame:
    return pieces.split_records(table(spark, d, "fasta_records"), "rec_id", "name", "seq")


@REG.add(
    "p1_found",
    """with s as (select rec_id, regexp_replace(seq, '\\s', '', 'g') as b from fasta_records)
    select rec_id, case when list_max(list_transform(string_split_regex(b, '[Nn]{10,}'), lambda x: length(x))) > 2000
    then 'inside' else 'boundary' end as cut_kind from s where length(b) > 2000""",
)
def p1_found(spark, d) -> DataFrame:
    return pieces.oversized(_pieces(spark, d)).select(F.col("rec_key").alias("rec_id"), "cut_kind")


@REG.add(
    "p1_pieces",
    """with recursive s as (select rec_id, coalesce(split_part(regexp_replace(trim(name, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g'), ' ', 1), '') as label,
   regexp_replace(seq, '\\s', '', 'g') as b from fasta_records),
 p as (select *, length(b) as n, list_transform(string_split_regex(b, '[Nn]{10,}'), lambda x: length(x)) as free, list_transform(regexp_extract_all(b, '[Nn]{10,}'), lambda x: length(x)) as run from s where b <> ''),
 q as (select rec_id, i, run[i] as strength, list_sum(free[1:i]) + coalesce(list_sum(run[1:i - 1]), 0) as place from p, unnest(range(1, len(run) + 1)) as t(i)),
 e as (select rec_id, place, strength from q union all select rec_id, place + strength, strength from q),
 c(rec_id, n, piece_no, start_at, end_at, cut_kind) as (select rec_id, n, -1, 0::hugeint, 60::hugeint, '' from p
  union all
  select c.rec_id, c.n, c.piece_no + 1, c.end_at - 60, case when c.n - (c.end_at - 60) <= 2000 then c.n else coalesce(x.place, c.end_at + 1940) end,
   case when c.n - (c.end_at - 60) <= 2000 then 'end' when x.place is not null or x.odd then 'boundary' else 'inside' end
  from c, lateral (select max_by(e.place, (e.strength, e.place)) filter (where e.place > c.end_at) as place, count(*) filter (where e.place <= c.end_at) % 2 = 1 as odd
   from e where e.rec_id = c.rec_id and e.place <= c.end_at + 1940) x
  where c.cut_kind <> 'end')
 select rec_id, piece_no::int as piece_no, case when label = '' then 'rec' || rec_id else label end || '_' || piece_no as piece_name, start_at::bigint as start_at, end_at::bigint as end_at, cut_kind, b[start_at + 1:end_at] as piece
 from c join s using (rec_id) where piece_no >= 0""",
)
def p1_pieces(spark, d) -> DataFrame:
    return _pieces(spark, d).select(F.col("rec_key").alias("rec_id"), "piece_no", "piece_name", "start_at", "end_at", "cut_kind", "piece")


_SHARED = """with f as (select rec_id, upper(regexp_replace(seq, '\\s', '', 'g')) as b from fasta_records),
 w as (select rec_id, i - 1 as place, b[i:i+63] as word from f, unnest(range(1, length(b) - 62)) as t(i)),
 k as (select word from w where not regexp_matches(word, '[^ACGT]') group by word having min(rec_id) <> max(rec_id)),
 h as (select rec_id, place from w semi join k using (word)),
 n as (select *, case when place <= lag(place) over (partition by rec_id order by place) + 64 then 0 else 1 end as fresh from h),
 g as (select *, sum(fresh) over (partition by rec_id order by place) as no from n),
 s as (select rec_id, min(place) as start_at, max(place) + 64 as end_at from g group by rec_id, no) """


def _spans(spark, d) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "fasta_records"), "rec_id", "seq")


@REG.add("p5_found", _SHARED + "select rec_id, start_at, end_at from s")
def p5_found(spark, d) -> DataFrame:
    return _spans(spark, d).withColumnRenamed("rec_key", "rec_id")


@REG.add("p5_shared_share", _SHARED + "select f.rec_id, coalesce(length(f.b), 0)::bigint as n_bases, coalesce(sum(end_at - start_at), 0)::bigint as n_shared from f left join s using (rec_id) group by 1, 2")
def p5_shared_share(spark, d) -> DataFrame:
    return shared_spans.shared_share(table(spark, d, "fasta_records"), "rec_id", "seq", _spans(spark, d)).withColumnRenamed("rec_key", "rec_id")


def _near(spark, d) -> tuple[DataFrame, DataFrame]:
    reads = table(spark, d, "fastq_reads").select(F.col("read_id").alias("id"), neardup.oriented(F.col("seq"), F.lit(False)).alias("seq"))
    reverse = F.coalesce(F.col("flag").bitwiseAND(16) != 0, F.lit(False))
    alns = table(spark, d, "sam_alignments").select(F.col("aln_id").alias("id"), neardup.oriented(F.col("seq"), reverse).alias("seq"))
    return neardup.near_duplicates(reads.unionByName(alns), "id", "seq", 0.5)


@REG.add(
    "p3_found",
    """with r as (select read_id as id, upper(regexp_replace(seq, '\\s', '', 'g')) as s from fastq_reads
  union select aln_id, case when flag & 16 <> 0 then reverse(translate(upper(regexp_replace(seq, '\\s', '', 'g')), 'ACGT', 'TGCA'))
  else upper(regexp_replace(seq, '\\s', '', 'g')) end from sam_alignments),
 w as (select distinct id, s[i:i+7] as word from r, unnest(range(1, length(s) - 6)) as t(i) where s <> '*'),
 n as (select id, count(*) as n from w group by id),
 j as (select a.id as id_a, b.id as id_b, count(*) as shared from w a join w b on a.word = b.word and a.id < b.id group by 1, 2)
 select id_a, id_b from j join n x on x.id = id_a join n y on y.id = id_b where 3 * shared >= x.n + y.n""",
)
def p3_found(spark, d) -> DataFrame:
    return neardup.record_pairs(*_near(spark, d))


@REG.add(
    "p3_groups",
    """with recursive r as (select read_id as id, upper(regexp_replace(seq, '\\s', '', 'g')) as s from fastq_reads
  union select aln_id, case when flag & 16 <> 0 then reverse(translate(upper(regexp_replace(seq, '\\s', '', 'g')), 'ACGT', 'TGCA'))
  else upper(regexp_replace(seq, '\\s', '', 'g')) end from sam_alignments),
 t as (select s, min(id) as class_id from r where s not in ('', '*') and id is not null group by s),
 w as (select distinct class_id, s[i:i+7] as word from t, unnest(range(1, length(s) - 6)) as u(i)),
 n as (select class_id, count(*) as n from w group by class_id),
 j as (select a.class_id as x, b.class_id as y, count(*) as shared from w a join w b on a.word = b.word and a.class_id < b.class_id group by 1, 2),
 l as (select x, y from j join n p on p.class_id = x join n q on q.class_id = y where 3 * shared >= p.n + q.n),
 e as (select x, y from l union all select y, x from l),
 g(x, y) as (select class_id, class_id from t union select g.x, e.y from g join e on g.y = e.x)
 select id, class_id, (select min(y) from g where g.x = t.class_id) as group_id, (select count(*) from e where e.x = t.class_id) as n_links
 from (select distinct id, s from r) join t using (s)""",
)
def p3_groups(spark, d) -> DataFrame:
    return neardup.groups(*_near(spark, d)).withColumnRenamed("rec_key", "id")


def _mixture(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = materialise(mixing.token_counts(table(spark, d, "documents"), ["doc_id", "source"], "text"), "tokens")
    return mixing.mix(docs, table(spark, d, "mix_targets"))


@REG.add("p8_uses")
def p8_uses(spark, d) -> DataFrame:
    return _mixture(spark, d)[0]


@REG.add("p8_shares")
def p8_shares(spark, d) -> DataFrame:
    return _mixture(spark, d)[1]


def _sentence_model(docs: DataFrame) -> sentences.Model:
    return sentences.fit_on(docs, "doc_id", "text", "line_boxes")


@REG.add("p9_found")
def p9_found(spark, d) -> DataFrame:
    pages = sentences.read_pages(table(spark, d, "documents"), "doc_id", "text", "line_boxes")
    return sentences.page_ends(pages, sentences.fit_pages(pages))


@REG.add("p9_sentences")
def p9_sentences(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return sentences.sentences(docs, "doc_id", "text", "line_boxes", _sentence_model(docs))


def _leaks(spark, d) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), "doc_id", "text", "line_boxes", table(spark, d, "eval_items"), "item_id", "text")


@REG.add("p7_found")
def p7_found(spark, d) -> DataFrame:
    return _leaks(spark, d).filter("in_a_row").select("doc_id", "item_id")


@REG.add("p7_coverage")
def p7_coverage(spark, d) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id", "longest", "coverage")
