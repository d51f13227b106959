"""Separating lines that fail to parse from valid typed records.

Each data line is split into cells, the cells that a rule judges are exploded to (line, column,
value) and joined with the rule table; the failed rules are aggregated by line, and the clean lines
are what an anti-join with the failures leaves. Lines are parsed once and kept for both results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.storage import materialise

UINT32 = 4294967295

# Kind, column (from 0), least number of columns for the rule to hold, check, lowest, highest.
RULES = [
    ("vcf", 0, 1, "contig", None, None),
    ("vcf", 1, 2, "within_contig", 1, None),
    ("vcf", 3, 4, "bases", None, None),
    ("vcf", 5, 6, "decimal_or_dot", None, None),
    ("sam", 1, 11, "whole", 0, 4095),
    ("sam", 2, 11, "contig_or_star", None, None),
    ("sam", 3, 11, "whole", 0, UINT32),
    ("sam", 4, 11, "whole", 0, 255),
    ("sam", 5, 11, "cigar", None, None),
    ("sam", 10, 11, "qualities", None, None),
    ("bed", 0, 1, "contig", None, None),
    ("bed", 1, 2, "whole", 0, UINT32),
    ("bed", 2, 3, "not_below_start", 0, UINT32),
    ("bed", 4, 6, "whole", 0, 1000),
    ("bed", 5, 6, "strand", None, None),
]

#: Kinds whose fields may be quoted, and the prefixes of lines that aren't data.
QUOTED = ("vcf", "bed")
HEADERS = {"vcf": ("#", "track", "browser"), "bed": ("#", "track", "browser"), "sam": ("@",)}


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "kind string, col_no int, least_cols int, check string, low long, high long")


def stripped(line: Column) -> Column:
    """Without one carriage return at the end and then one tab at the end."""
    drop = lambda x, c: F.when(x.endswith(c), F.left(x, F.length(x) - 1)).otherwise(x)
    return drop(drop(line, "\r"), "\t")


def _quoted_fields(body: Column) -> Column:
    """Fold over the tab-parted pieces: a piece that opens a quote takes the following ones until it closes."""

    def step(state: Column, piece: Column) -> Column:
        opened = state["held"].isNotNull()
        text = F.when(opened, F.concat(state["held"], F.lit("\t"), piece)).otherwise(piece)
        quoted = text.startswith('"')
        rest = F.regexp_replace(text.substr(F.lit(2), F.length(text)), '""', "")
        at = F.instr(rest, '"')
        closed = quoted & (at > 0) & (at == F.length(rest))
        wrong = quoted & (at > 0) & (at < F.length(rest))
        holds = quoted & (at == 0)
        value = F.when(closed, F.regexp_replace(text.substr(F.lit(2), F.length(text) - 2), '""', '"')).otherwise(text)
        return F.struct(
            F.when(holds, state["fields"]).otherwise(F.concat(state["fields"], F.array(value))).alias("fields"),
            F.when(holds, text).alias("held"),
            (state["bad"] | wrong).alias("bad"),
        )

    zero = F.struct(F.array().cast("array<string>").alias("fields"), F.lit(None).cast("string").alias("held"), F.lit(False).alias("bad"))
    return F.aggregate(F.split(body, "\t"), zero, step)


def split_lines(lines: DataFrame) -> DataFrame:
    """The data lines as ``line_id, file_kind, fields, quote_ok, expected``.

    ``expected`` is the number of fields of the file's own column line, null if it has none (then
    the number isn't judged) and for sam. Null lines, blank lines, headers and lines of other kinds
    are not data.
    """
    base = lines.select("line_id", "file_kind", "file_name", "line_no", stripped(F.col("line")).alias("body")).filter("body is not null and trim(translate(body, '\t\r', '  ')) <> ''")
    kinds = base.filter(F.col("file_kind").isin(*HEADERS))
    named = kinds.filter(F.col("file_kind").isin(*QUOTED) & F.col("body").startswith("#") & ~F.col("body").startswith("##"))
    expected = named.groupBy(F.col("file_name").alias("of_name"), F.col("file_kind").alias("of_kind")).agg(F.size(F.split(F.min_by("body", F.struct("line_no", "line_id")), "\t")).alias("expected"))
    # of known size once written, so the lines aren't shuffled to meet a table of a row for each file
    expected = materialise(expected, "columns")
    header = F.lit(False)
    for kind, marks in HEADERS.items():
        for m in marks:
            header = header | ((F.col("file_kind") == kind) & F.col("body").startswith(m))
    data = kinds.filter(~header)
    joined = data.join(expected, F.expr("file_name <=> of_name and file_kind = of_kind"), "left").drop("of_name", "of_kind")
    risky = F.col("file_kind").isin(*QUOTED) & (F.col("body").startswith('"') | F.col("body").contains('\t"'))
    parsed = joined.withColumn("parsed", F.when(risky, _quoted_fields(F.col("body"))))
    return parsed.select(
        "line_id", "file_kind", "file_name", "expected",
        F.coalesce("parsed.fields", F.split("body", "\t")).alias("fields"),
        F.coalesce(~F.col("parsed.bad") & F.col("parsed.held").isNull(), F.lit(True)).alias("quote_ok"),
    )


def _passes() -> Column:
    """Whether ``value`` passes ``check``; ``contig_bp`` and ``peer`` come from the same line."""
    v = F.col("value")
    whole_number = lambda x: F.when(x.rlike(r"\A0*[0-9]{1,18}\z"), x).try_cast("long")
    number = whole_number(v)
    whole = F.coalesce(number.between(F.col("low"), F.coalesce(F.col("high"), F.lit(UINT32))), F.lit(False))
    peer = whole_number(F.col("peer"))
    quals = (v == "*") | (v.rlike(r"\A[!-~]*\z") & ((F.col("peer") == "*") | (F.length(v) == F.length("peer"))))
    checks = {
        "contig": F.col("contig_bp").isNotNull(),
        "contig_or_star": (v == "*") | F.col("contig_bp").isNotNull(),
        "within_contig": whole & F.coalesce(number <= F.col("contig_bp"), F.lit(False)),
        "bases": v.rlike(r"\A[ACGTNacgtn]+\z"),
        "decimal_or_dot": v.rlike(r"\A(\.|[0-9]+(\.[0-9]+)?)\z"),
        "whole": whole,
        "cigar": v.rlike(r"\A(\*|([0-9]+[MIDNSHP=X])+)\z"),
        "qualities": quals,
        "not_below_start": whole & F.coalesce(number >= peer, F.lit(True)),
        "strand": v.isin("+", "-", "."),
    }
    out = F.lit(True)
    for name, ok in checks.items():
        out = F.when(F.col("check") == name, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def judge_lines(lines: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of raw lines.

    ``valid`` has ``line_id, file_kind, file_name, fields``; ``rejected`` has ``line_id, file_kind,
    reason, errors`` where ``reason`` is the first that holds of ``quoting``, ``column_count`` and
    ``value``, and ``errors`` lists the failed columns of a line whose reason is ``value``. Lines
    with equal ``line_id`` are told apart only by it, so ids must be unique. Both are empty for an
    empty table; other columns of the tables are ignored.
    """
    rows = split_lines(lines)
    count_ok = F.when(F.col("file_kind") == "sam", F.size("fields") >= 11).otherwise(F.coalesce(F.size("fields") == F.col("expected"), F.lit(True)))
    shape = F.when(~F.col("quote_ok"), "quoting").when(~count_ok, "column_count")
    rows = materialise(rows.select("line_id", "file_kind", "file_name", "fields", shape.alias("shape")), "parsed")
    shaped = rows.filter("shape is null")
    cell = lambda i: F.get("fields", F.lit(i))
    sam, bed = (F.col("file_kind") == k for k in ("sam", "bed"))
    # only the cells that the rules name, so that lines of thousands of samples don't become thousands of rows
    ruled = F.lit(None)
    for kind in HEADERS:
        ruled = F.when(F.col("file_kind") == kind, F.array(*[F.struct(F.lit(c).alias("col_no"), cell(c).alias("value")) for k, c, *_ in RULES if k == kind])).otherwise(ruled)
    cells = shaped.select(
        "line_id", "file_kind", F.when(sam, cell(2)).otherwise(cell(0)).alias("where"), F.when(sam, cell(9)).when(bed, cell(1)).alias("peer"),
        F.size("fields").alias("n_cols"), F.inline(ruled),
    ).filter("value is not null")
    rules = rule_table(lines.sparkSession).withColumnsRenamed({"kind": "rule_kind", "col_no": "rule_col"})
    named = cells.join(F.broadcast(rules), (F.col("file_kind") == F.col("rule_kind")) & (F.col("col_no") == F.col("rule_col")) & (F.col("n_cols") >= F.col("least_cols")))
    sizes = contigs.groupBy("spelling").agg(F.max("length_bp").alias("contig_bp"))
    of_contig = F.when(F.col("check").isin("contig", "contig_or_star", "within_contig"), F.col("where"))
    judged = named.join(sizes, of_contig == F.col("spelling"), "left")
    failed = judged.filter(~_passes()).groupBy("line_id", "file_kind").agg(F.sort_array(F.collect_set("col_no")).alias("errors"))
    rejected = (
        rows.filter("shape is not null").select("line_id", "file_kind", F.col("shape").alias("reason"), F.array().cast("array<int>").alias("errors"))
        .unionByName(failed.select("line_id", "file_kind", F.lit("value").alias("reason"), "errors"))
    )
    valid = shaped.join(failed.select("line_id"), "line_id", "left_anti").select("line_id", "file_kind", "file_name", "fields")
    return valid, rejected


def typed_records(valid: DataFrame, kind: str) -> DataFrame:
    """The valid lines of one kind with their columns cast to the record's types; absent columns are null."""
    names = {
        "vcf": [("chrom", "string"), ("pos", "long"), ("id", "string"), ("ref", "string"), ("alt", "string"), ("qual", "double"), ("filters", "string"), ("info", "string"), ("format_keys", "string")],
        "sam": [("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "int"), ("seq", "string"), ("qual", "string")],
        "bed": [("chrom", "string"), ("start_pos", "long"), ("end_pos", "long"), ("name", "string"), ("score", "int"), ("strand", "string"), ("thick_start", "long"), ("thick_end", "long"), ("item_rgb", "string"), ("block_count", "int"), ("block_sizes", "string"), ("block_starts", "string")],
    }[kind]
    cols = [F.get("fields", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(names)]
    rest = {"vcf": "samples", "sam": "optionals"}.get(kind)
    if rest:
        cols.append(F.slice("fields", len(names) + 1, F.greatest(F.size("fields") - len(names), F.lit(0))).alias(rest))
    return valid.filter(F.col("file_kind") == kind).select("line_id", *cols)
