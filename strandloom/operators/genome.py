"""Genome-wide operators: reference statistics, N runs, tiles, k-mers, sampling, consensus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import seq as sq


def base_counts(df: DataFrame, seq: str) -> DataFrame:
    """``base, n``: totals of A, C, G, T and of everything else as N."""
    clean = F.regexp_replace(F.upper(seq), r"\s", "")
    per = [F.coalesce(F.sum(sq.base_count(clean, b)), F.lit(0)).alias(b) for b in "ACGT"]
    sums = df.agg(*per, F.coalesce(F.sum(F.length(clean)), F.lit(0)).alias("all"))
    sums = sums.withColumn("N", F.expr("`all` - A - C - G - T"))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).cast("long").alias("n")) for b in "ACGTN"])).alias("x")).select("x.*")


def chromosome_bounds(df: DataFrame, order: str, length: Column) -> DataFrame:
    """``*df, begin, end``: running bounds of all sequences laid one after another by ``order``.

    One row per chromosome takes part, never per base.
    """
    by = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end", F.sum(length).over(by)).withColumn("begin", F.col("end") - length)


def unknown_runs(df: DataFrame, key: str, seq: str, least: int = 1) -> DataFrame:
    """``rec_key, begin, end``: the maximal runs of N of each sequence, half-open, either case."""
    import re

    kind = df.schema[key].dataType.simpleString()
    run_of = re.compile(rf"[Nn]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lo, hi = [], [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                for m in run_of.finditer("".join((s or "").split())):
                    rows.append(i)
                    lo.append(m.start())
                    hi.append(m.end())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["rec_key", "begin", "end"])

    return df.select(key, seq).mapInArrow(run, f"rec_key {kind}, begin long, end long")


def tiles(df: DataFrame, begin: str, length: Column | None = None, window: int = 100) -> DataFrame:
    """Rows with each ``tile`` they belong to: tile i takes begins in [i * window, (i + 3) * window).

    ``length`` is that of the chromosome; tiles beyond the last whole window are left out.
    """
    at = F.expr(f"`{begin}` div {window}")
    low = F.greatest(at - 2, F.lit(0).cast("long"))
    out = df.filter(F.col(begin) >= 0).withColumn("tile", F.explode(F.sequence(low, at)))
    return out if length is None else out.filter(F.col("tile") < F.ceil((length - window) / window))


def sampled(df: DataFrame, keys: list[str], order: Column, n: int = 5) -> DataFrame:
    """At most ``n`` rows per key, those with the smallest ``order`` (a sampling operator)."""
    by = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("rank_", F.row_number().over(by)).filter(F.col("rank_") <= n).drop("rank_")


#: Windows of a sequence that are worked on at once.
SLICE = 1 << 20


def _words(text: str | None, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, words) of slices of a text's k-letter windows, without copying one window at a time."""
    raw = np.frombuffer((text or "").encode("ascii", "replace"), np.uint8)
    for at in range(0, len(raw) - k + 1, SLICE):
        part = raw[at : at + SLICE + k - 1]
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, k))
        yield at, windows.view(f"S{k}").ravel()


def _strings(words: np.ndarray) -> pa.Array:
    """Words of one length as text, without an object for each."""
    words, k = np.ascontiguousarray(words), words.dtype.itemsize
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.arange(0, (len(words) + 1) * k, k, dtype=np.int32)), pa.py_buffer(words))


def _counted(df: DataFrame, seq: Column, k: int) -> DataFrame:
    """``kmer, n`` counted within a bounded number of windows and then over all."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        w, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([_strings(w), pa.array(n.astype(np.int64))], ["kmer", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0
            for s in b.column(0):
                for _, w in _words(s.as_py(), k):
                    parts.append(w)
                    held += len(w)
                    if held >= SLICE:
                        yield counted(parts)
                        parts, held = [], 0
            if parts:
                yield counted(parts)

    return df.select(seq.alias("s")).mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def kmer_counts(df: DataFrame, seq: Column, k: int) -> DataFrame:
    """``kmer, n`` over all sequences. Null and shorter sequences have none."""
    return _counted(df, seq, k)


def edge_counts(df: DataFrame, seq: Column, k: int) -> DataFrame:
    """``source, target, n``: edges between successive k-mers (a de Bruijn graph's multiplicities)."""
    edges = _counted(df, seq, k + 1)
    return edges.select(F.substr("kmer", F.lit(1), F.lit(k)).alias("source"), F.substr("kmer", F.lit(2), F.lit(k)).alias("target"), "n")


def repeated_kmers(df: DataFrame, key: str, seq: Column, k: int) -> DataFrame:
    """``kmer``: those that occur more than once within some sequence; every row is a sequence of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for s in b.column(0).to_pylist():
                parts = [w for _, w in _words(s, k)]
                if parts:
                    w, n = np.unique(np.concatenate(parts), return_counts=True)
                    found.append(w[n > 1])
            if found:
                yield pa.RecordBatch.from_arrays([_strings(np.unique(np.concatenate(found)))], ["kmer"])

    return df.select(seq.alias("s")).mapInArrow(run, "kmer string").distinct()


def kmer_places(df: DataFrame, key: str, seq: Column, k: int) -> DataFrame:
    """``rec_key, place, kmer``: every window of every sequence (a posting table, never collected)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(b.column(1).to_pylist()):
                for at, w in _words(s, k):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(w), i))), pa.array(np.arange(at, at + len(w), dtype=np.int64)), _strings(w)], ["rec_key", "place", "kmer"])

    return df.select(F.col(key), seq.alias("s")).mapInArrow(run, f"rec_key {kind}, place long, kmer string")


def best_per_place(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row by ``order`` for each key."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_", F.row_number().over(by)).filter("rank_ = 1").drop("rank_")


def score_band(df: DataFrame, keys: list[str], score: str, width: int = 30) -> DataFrame:
    """Rows whose score is within ``width`` of their key's best; a score that is null is dropped."""
    top = df.groupBy(*keys).agg(F.max(score).alias("top_"))
    return df.join(top, keys).filter(F.col(score) >= F.col("top_") - width).drop("top_")


def score_summary(df: DataFrame, keys: list[str], score: str, near: int = 5) -> DataFrame:
    """``*keys, best, second, n_second``: best score, next one, and how many others reach ``second - near``."""
    by = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    ranked = df.filter(F.col(score).isNotNull()).select(*keys, F.col(score).alias("s_"), F.row_number().over(by).alias("k_"), F.lead(score).over(by).alias("next_"))
    second = ranked.withColumn("second_", F.max(F.when(F.col("k_") == 2, F.col("s_"))).over(Window.partitionBy(*keys)))
    return second.groupBy(*keys).agg(
        F.max(F.when(F.col("k_") == 1, F.col("s_"))).alias("best"),
        F.coalesce(F.max("second_"), F.lit(0)).alias("second"),
        F.sum(F.when((F.col("k_") > 1) & (F.col("s_") >= F.col("second_") - near), 1).otherwise(0)).alias("n_second"),
    )


def consensus(reference: DataFrame, variants: DataFrame) -> DataFrame:
    """``chrom, seq``: each chromosome's sequence with its variants' alternatives spliced in.

    ``reference`` has ``chrom, seq``; ``variants`` ``chrom, pos`` (1-based), ``ref, alt``. A ``.``
    as ref is an insertion before the base, as alt a deletion. Of overlapping variants the first by
    position holds; of several alternatives the first. Unknown chromosomes' variants are ignored.
    """
    v = variants.dropna(subset=["chrom", "pos", "ref", "alt"]).groupBy("chrom").agg(
        F.sort_array(F.collect_set(F.struct(F.col("pos").cast("long").alias("pos"), F.when(F.col("ref") == ".", "").otherwise(F.col("ref")).alias("ref"), F.when(F.col("alt") == ".", "").otherwise(F.split("alt", ",")[0]).alias("alt")))).alias("v_")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(2)
            pos, ref, alt = (x.to_pylist() for x in held.values.flatten())
            ends, out = held.offsets.to_pylist(), []
            for i, seq in enumerate(b.column(1).to_pylist()):
                parts, at = [], 0
                for k in range(ends[i], ends[i + 1]) if seq is not None else ():
                    if at <= pos[k] - 1 <= len(seq):
                        parts += (seq[at : pos[k] - 1], alt[k])
                        at = pos[k] - 1 + len(ref[k])
                out.append(None if seq is None else "".join([*parts, seq[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["chrom", "seq"])

    kind = reference.schema["chrom"].dataType.simpleString()
    none = F.array().cast(v.schema["v_"].dataType)
    return reference.select("chrom", "seq").join(v, "chrom", "left").select("chrom", "seq", F.coalesce("v_", none).alias("v_")).mapInArrow(run, f"chrom {kind}, seq string")
