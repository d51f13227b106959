"""Readers of line formats on Spark's text source, and of FASTA by its record separator.

All are splittable for plain files, take gzip by suffix, and push column pruning to the split.
Fields are parted by tabs; missing and unreadable fields take the record type's defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import schemas

# How header lines begin.
HEADERS = {"sam": ("@",), "vcf": ("#",), "bed": ("browser", "track", "#"), "gff": ("#",), "wig": ("browser", "track", "#", "variableStep", "fixedStep")}

# Defaults of absent fields.
DEFAULTS = {
    "bed": {"score": 0, "item_rgb": "0,0,0", "block_count": 0, "block_sizes": "0", "block_starts": "0", "thick_start": 0, "thick_end": 0},
    "gff": {"seqid": ".", "source": ".", "type": ".", "start": 0, "end": 0, "score": 0.0, "strand": ".", "phase": 0, "attrs": "."},
}


def _is_header(marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.col("value").startswith(m)
    return out


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``: the lines without carriage returns at their ends."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def header(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The header lines of a file."""
    return lines(spark, path).filter(_is_header(HEADERS[kind]))


def records(df: DataFrame, ddl: str, marks: tuple[str, ...] = (), defaults: dict | None = None) -> DataFrame:
    """Typed records of lines (column ``value``); an array at the schema's end takes all further fields."""
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(ddl).fields
    parts = F.split("value", "\t")
    body = df.filter(F.col("value").isNotNull() & (F.trim("value") != "") & ~_is_header(marks)) if marks else df.filter(F.trim("value") != "")
    cols = []
    for i, f in enumerate(fields):
        if isinstance(f.dataType, T.ArrayType):
            rest = F.slice(parts, i + 1, F.greatest(F.size(parts) - i, F.lit(0)))
            cols.append(F.filter(rest, lambda x: x != "").alias(f.name))
            continue
        c = F.get(parts, F.lit(i))
        c = F.trim(c).try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else c
        if defaults and f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return body.select(*cols)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return records(lines(spark, path), schemas.SAM, HEADERS["sam"])


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return records(lines(spark, path), schemas.VCF, HEADERS["vcf"])


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return records(lines(spark, path), schemas.BED, HEADERS["bed"], DEFAULTS["bed"])


def read_bed_graph(spark: SparkSession, path: str) -> DataFrame:
    return records(lines(spark, path), schemas.BED_GRAPH, HEADERS["bed"])


def read_bed_six(spark: SparkSession, path: str) -> DataFrame:
    return records(lines(spark, path), schemas.BED_SIX, HEADERS["bed"])


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Nine columns; ``attributes`` besides as a map, of GFF3 (``k=v``) and GTF (``k "v"``) alike."""
    return with_attributes(records(lines(spark, path), schemas.GFF, HEADERS["gff"], DEFAULTS["gff"]))


def with_attributes(t: DataFrame) -> DataFrame:
    """GFF records with their attributes as a map; of a key that repeats the first value holds."""
    pattern = r'^\s*([^\s=]+)[\s=]+"?([^"]*)"?\s*$'
    good = F.filter(F.split("attrs", ";"), lambda x: x.rlike(pattern))
    key = F.transform(good, lambda x: F.regexp_extract(x, pattern, 1))
    val = F.transform(good, lambda x: F.regexp_extract(x, pattern, 2))
    entries = F.array_distinct(key)
    return t.withColumn("attributes", F.map_from_arrays(entries, F.transform(entries, lambda k: F.element_at(val, F.array_position(key, k).cast("int")))))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq``: the whole header line without its mark, and the lines of the sequence joined."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", r"\A\s*>|\r", "")
    name = F.trim(F.regexp_extract(text, r"\A([^\n]*)", 1))
    seq = F.regexp_replace(F.regexp_extract(text, r"(?s)\A[^\n]*\n(.*)", 1), r"\s", "")
    return raw.filter(F.trim("value") != "").select(name.alias("name"), seq.alias("seq"))


# Annotations, all as seqid, start (0-based), end, strand, gene_type, gene_name.


def _columns(df: DataFrame) -> DataFrame:
    return df.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("c", F.split("value", "\t"))


def _six(df: DataFrame, seqid: Column, start: Column, end: Column, strand: Column, kind: Column, name: Column) -> DataFrame:
    return df.select(seqid.alias("seqid"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.left(strand, F.lit(1)).alias("strand"), kind.alias("gene_type"), name.alias("gene_name"))


def mirtron_db(df: DataFrame) -> DataFrame:
    """mirtronDB's padded columns; rows without coordinates or without a miRBase name are left out."""
    t = _columns(df).withColumn("c", F.transform("c", lambda x: F.trim(x))).filter("c[0] <> 'seq_id' and c[3] <> '' and c[4] <> ''")
    arm, name = (F.regexp_extract(F.col("c")[8], f"{k}:([^;]*)", 1) for k in ("arm_steem", "miRBase_id"))
    t = t.filter(name != "-")
    return _six(t, F.concat(F.lit("chr"), F.col("c")[0]), F.col("c")[3].cast("long") - 1, F.col("c")[4], F.col("c")[6], F.lit("mirtron"), F.concat(name, F.lit("-"), arm))


def mir_base(df: DataFrame) -> DataFrame:
    """miRBase's mature miRNAs."""
    t = _columns(df).filter("c[2] = 'miRNA'")
    return _six(t, F.col("c")[0], F.col("c")[3].cast("long") - 1, F.col("c")[4], F.col("c")[6], F.lit("miRNA"), F.regexp_extract(F.col("c")[8], "Name=([^;]*)", 1))


def gencode(df: DataFrame, style: str = "gtf", feature: str = "gene") -> DataFrame:
    """GENCODE's features of one type, from GTF or GFF3."""
    pattern = {"gtf": '{} "([^"]*)"', "gff3": "{}=([^;]*)"}[style]
    t = _columns(df).filter(F.col("c")[2] == feature)
    kind, name = (F.regexp_extract(F.col("c")[8], pattern.format(k), 1) for k in ("gene_type", "gene_name"))
    return _six(t, F.col("c")[0], F.col("c")[3].cast("long") - 1, F.col("c")[4], F.col("c")[6], kind, name)


def _halves(df: DataFrame, seqid: Column, start: Column, end: Column, strand: Column, name: Column) -> DataFrame:
    """Each tRNA as two fragments, split in its middle; 5p is the half at the strand's own beginning."""
    t = df.select(seqid.alias("seqid"), start.cast("long").alias("a"), end.cast("long").alias("z"), F.left(strand, F.lit(1)).alias("strand"), name.alias("n"))
    t = t.withColumn("mid", F.expr("(z - a) div 2 + a"))
    first = F.when(F.col("strand") == "+", "-5p").otherwise("-3p")
    second = F.when(F.col("strand") == "+", "-3p").otherwise("-5p")
    parts = F.array(F.struct(F.col("a").alias("start"), F.col("mid").alias("end"), F.concat("n", first).alias("g")), F.struct(F.col("mid").alias("start"), F.col("z").alias("end"), F.concat("n", second).alias("g")))
    return t.select("seqid", "strand", F.explode(parts).alias("p")).select("seqid", "p.start", "p.end", "strand", F.lit("tRF").alias("gene_type"), F.col("p.g").alias("gene_name"))


def gencode_trna(df: DataFrame, style: str = "gtf") -> DataFrame:
    pattern = {"gtf": '{} "([^"]*)"', "gff3": "{}=([^;]*)"}[style]
    t = _columns(df)
    kind, name = (F.regexp_extract(F.col("c")[8], pattern.format(k), 1) for k in ("gene_type", "transcript_id"))
    return _halves(t, F.col("c")[0], F.col("c")[3].cast("long") - 1, F.col("c")[4], F.col("c")[6], F.concat(F.split(kind, "_")[0], F.lit("-"), name))


def gtrna_db(df: DataFrame) -> DataFrame:
    """GtRNAdb's BED; unplaced contigs are left out, names of fewer than three parts are an error."""
    t = _columns(df).filter(~F.col("c")[0].startswith("chrUn")).withColumn("p", F.split(F.col("c")[3], "-"))
    tail = F.slice("p", F.lit(4), F.greatest(F.size("p") - 3, F.lit(0)))
    name = F.concat(F.col("p")[1], F.lit("-"), F.get("p", F.lit(2)), F.array_join(F.transform(tail, lambda x: F.concat(F.lit("_"), x)), ""))
    checked = F.when(F.size("p") >= 3, name).otherwise(F.raise_error(F.concat(F.lit("not a tRNA name: "), F.col("c")[3])).cast("string"))
    return _halves(t, F.col("c")[0], F.col("c")[1], F.col("c")[2], F.col("c")[5], checked)
