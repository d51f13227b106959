"""Cutting oversized sequences into overlapping pieces at natural boundaries.

A boundary is a run of N. The strength of a cut is the length of its run; a sparse table over the
strengths answers "strongest cut in this window" in constant time, with ties broken rightward.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = re.compile(r"\s+")


class RangeMax:
    """Index of the largest value in any range, the rightmost of equal ones."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.levels = [np.arange(len(values))]
        width = 1
        while 2 * width <= len(values):
            low = self.levels[-1]
            a, b = low[: len(low) - width], low[width:]
            self.levels.append(np.where(values[b] >= values[a], b, a))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """For the half-open range, which must not be empty."""
        k = (hi - lo).bit_length() - 1
        a, b = int(self.levels[k][lo]), int(self.levels[k][hi - (1 << k)])
        return b if self.values[b] >= self.values[a] else a


def boundary_runs(seq: str, least: int) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rf"[Nn]{{{least},}}", seq)]


def cut(length: int, runs: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, str, int | None]]:
    """(start, end, kind of the cut at the end, free stretch around it) of the pieces of a sequence.

    Every piece but the last ends at the strongest cut among the ends that make it longer than the
    overlap and no longer than the limit; either edge of a run is a cut. Without one it ends at the
    limit: still at a boundary within a run, else ``inside``; the length of the stretch without boundaries that it parts is given too.
    The next piece begins ``overlap`` before.
    """
    if length == 0:
        return []
    places = np.array([x for r in runs for x in r], dtype=np.int64)
    table = RangeMax(np.array([b - a for a, b in runs for _ in "ab"], dtype=np.int64))
    out, start = [], 0
    while length - start > limit:
        lo, hi = np.searchsorted(places, [start + overlap + 1, start + limit + 1])
        if lo < hi:
            end, kind, free = int(places[table.query(int(lo), int(hi))]), "boundary", None
        elif lo % 2:  # in the middle of a run longer than the limit
            end, kind, free = start + limit, "boundary", None
        else:
            end, kind = start + limit, "inside"
            # no edge lies between start + overlap and the cut; one at the cut would have been taken
            free = int((places[hi] if hi < len(places) else length) - (places[lo - 1] if lo else 0))
        out.append((start, end, kind, free))
        start = end - overlap
    return [*out, (start, length, "end", None)]


def split_records(df: DataFrame, key: str, name: str, seq: str, limit: int = 2000, overlap: int = 60, least_run: int = 10) -> DataFrame:
    """Pieces of every sequence: ``rec_key, piece_no, piece_name, start_at, end_at, cut_kind,
    free_stretch, piece``.

    White space isn't part of a sequence; positions are 0-based and half-open without it. Null,
    empty and blank sequences have no pieces; one within the limit has one piece. Pieces are named
    by the first word of ``name`` (``rec<key>`` where it is null or blank) and their number.
    Repeated rows give repeated pieces. Other columns are ignored whatever their names.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    kind = df.schema[key].dataType.simpleString()
    schema = f"rec_key {kind}, piece_no int, piece_name string, start_at long, end_at long, cut_kind string, free_stretch long, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            size = 0
            for k, n, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = SPACE.sub("", s or "")
                if not s:
                    continue
                runs = boundary_runs(s, least_run)
                label = (n or "").split()
                label = label[0] if label else f"rec{k}"
                for i, (a, b, kind_, free) in enumerate(cut(len(s), runs, limit, overlap)):
                    for c, v in zip(cols, (k, i, f"{label}_{i}", a, b, kind_, free, s[a:b])):
                        c.append(v)
                    size += b - a
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types(batch))], names)
                    cols, size = [[] for _ in range(8)], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types(batch))], names)

    names = [x.split()[0] for x in schema.split(", ")]

    def types(batch: pa.RecordBatch) -> list[pa.DataType]:
        long, text = pa.int64(), pa.string()
        return [batch.schema.field(0).type, pa.int32(), text, long, long, text, long, text]

    return df.select(F.col(key), F.col(name), F.col(seq)).mapInArrow(run, schema)


def oversized(pieces: DataFrame, limit: int = 2000) -> DataFrame:
    """``rec_key, cut_kind`` of the records that had to be cut: ``inside`` where a cut parts a
    stretch free of boundaries that is longer than the limit, else ``boundary``.

    Such a stretch can't be cut in any other way. A stretch a little shorter than the limit may be
    cut inside too, as a piece begins an overlap before its own bases; that alone isn't ``inside``.
    """
    parted = F.max(F.coalesce((F.col("cut_kind") == "inside") & (F.col("free_stretch") > limit), F.lit(False)))
    cuts = pieces.filter("cut_kind <> 'end'").groupBy("rec_key").agg(parted.alias("parted"))
    return cuts.select("rec_key", F.when(F.col("parted"), "inside").otherwise("boundary").alias("cut_kind"))
