"""Readers and writers of genomic files, and the choice of one by a file's suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def kind_of(path: str) -> str:
    """The format of a path by its suffix, ``.gz`` aside."""
    suffix = path.lower().removesuffix(".gz").rpartition(".")[2]
    known = {"fa": "fasta", "fasta": "fasta", "fna": "fasta", "fq": "fastq", "fastq": "fastq", "sam": "sam", "bam": "bam", "vcf": "vcf", "bed": "bed", "bedgraph": "bed_graph", "gff": "gff", "gff3": "gff", "gtf": "gff", "wig": "wig"}
    if suffix not in known:
        raise ValueError(f"unknown format: {path}")
    return known[suffix]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file by its suffix."""
    from strandloom.sources import streams, text

    kind = kind_of(path)
    if kind in ("fastq", "bam", "wig"):
        streams.register(spark)
        return spark.read.format(kind).option("path", path).load()
    return getattr(text, f"read_{kind}")(spark, path)
