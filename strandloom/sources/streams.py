"""Python data sources for formats whose records depend on what stands before them in the file.

Each file, or each byte range of a plain FASTQ file, is a partition and is read as a stream, so a
task holds one batch of records at most. Paths must be readable by every executor (a shared folder).
"""

from __future__ import annotations

import glob
import gzip
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandloom import schemas

BATCH = 5000


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(p for p in glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))
    if not found:
        raise FileNotFoundError(path)
    return found


def _open(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def fastq_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """Records whose sequence and qualities may go over several lines; qualities end with the sequence's length."""
    line = next(lines, None)
    while line is not None:
        if not line.strip():
            line = next(lines, None)
            continue
        if not line.startswith("@"):
            raise ValueError(f"not the head of a FASTQ record: {line[:80]}")
        name, seq, qual = line[1:], [], []
        line = next(lines, None)
        while line is not None and not line.startswith("+"):
            seq.append(line.strip())
            line = next(lines, None)
        size, have = sum(map(len, seq)), 0
        line = next(lines, None)
        while line is not None and (have < size or (size == 0 and line == "")):
            qual.append(line)
            have += len(line)
            if have >= size:
                line = next(lines, None)
                break
            line = next(lines, None)
        if have != size:
            raise ValueError(f"qualities of {name[:80]} don't have the length of the sequence")
        yield name, "".join(seq), "".join(qual)


@dataclass
class Span(InputPartition):
    path: str
    begin: int
    end: int  # -1: the whole file


def _text(f) -> Iterator[str]:
    for raw in f:
        yield raw.decode().rstrip("\r\n")


def _begins_record(four: list[bytes]) -> bool:
    return len(four) == 4 and four[0][:1] == b"@" and four[2][:1] == b"+" and len(four[1].strip()) == len(four[3].strip())


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Span]:
        return [Span(p, 0, -1) for p in _files(self.options["path"])]

    def rows(self, span: Span) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for r in self.rows(span):
            held.append(r)
            if len(held) >= BATCH:
                yield self.batch(held)
                held = []
        if held:
            yield self.batch(held)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.types)], self.names)


class _FastqReader(_Reader):
    names, types = ["name", "seq", "qual"], [pa.string()] * 3

    def partitions(self) -> list[Span]:
        """Plain files of four-line records are cut in byte ranges; gzip and ``multiline`` files aren't."""
        size = int(self.options.get("splitbytes", 64 << 20))
        out = []
        for p in _files(self.options["path"]):
            if p.endswith(".gz") or self.options.get("multiline", "false").lower() == "true":
                out.append(Span(p, 0, -1))
            else:
                total = os.path.getsize(p)
                out += [Span(p, a, min(a + size, total)) for a in range(0, total, size)]
        return out

    def rows(self, span: Span) -> Iterator[tuple]:
        with _open(span.path) as f:
            if span.end < 0:
                yield from fastq_records(_text(f))
                return
            if span.begin:
                f.seek(span.begin - 1)
                f.readline()  # a line that begins before the range belongs to the range before
                at, window = [], []
                while len(window) < 4:
                    at.append(f.tell())
                    window.append(f.readline())
                    if not window[-1]:
                        return
                while not _begins_record(window):
                    at, window = [*at[1:], f.tell()], [*window[1:], f.readline()]
                    if not window[-1]:
                        return
                f.seek(at[0])
            while f.tell() < span.end:
                four = [f.readline().decode().rstrip("\r\n") for _ in range(4)]
                if not four[0]:
                    continue
                if four[0][0] != "@" or four[2][:1] != "+" or len(four[1]) != len(four[3]):
                    raise ValueError(f"not a record of four lines (option multiline?): {four[0][:80]}")
                yield four[0][1:], four[1], four[3]


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return schemas.FASTQ

    def reader(self, schema: StructType) -> _FastqReader:
        return _FastqReader(schema, self.options)


class _WigReader(_Reader):
    names, types = ["chrom", "start", "span", "value"], [pa.string(), pa.int64(), pa.int32(), pa.float32()]

    def rows(self, span: Span) -> Iterator[tuple]:
        chrom, at, step, width, fixed = None, 0, 1, 1, False
        with _open(span.path) as f:
            for line in _text(f):
                if not line.strip() or line.startswith(("#", "browser", "track")):
                    continue
                if line.startswith(("variableStep", "fixedStep")):
                    opts = dict(re.findall(r"(\w+)=(\S+)", line))
                    fixed, chrom, width = line.startswith("fixed"), opts.get("chrom"), int(opts.get("span", 1))
                    at, step = int(opts.get("start", 1)), int(opts.get("step", 1))
                elif fixed:
                    yield chrom, at, width, float(line)
                    at += step
                else:
                    place, value = line.split()
                    yield chrom, int(place), width, float(value)


class WigSource(DataSource):
    """``chrom, start`` (1-based), ``span, value`` of both kinds of step."""

    @classmethod
    def name(cls) -> str:
        return "wig"

    def schema(self) -> str:
        return schemas.WIG

    def reader(self, schema: StructType) -> _WigReader:
        return _WigReader(schema, self.options)


# BAM

_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def inflate(f) -> Iterator[bytes]:
    """The contents of BGZF blocks, one after another."""
    while head := f.read(18):
        extra = struct.unpack("<H", head[10:12])[0]
        size = struct.unpack("<H", head[16:18])[0] + 1
        f.read(extra - 6)
        data = f.read(size - 12 - extra - 8)
        f.read(8)
        yield zlib.decompress(data, -15)


class _Bytes:
    """Exact reads over a stream of blocks."""

    def __init__(self, blocks: Iterator[bytes]) -> None:
        self.blocks, self.held = blocks, b""

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            b = next(self.blocks, None)
            if b is None:
                break
            parts.append(b)
            have += len(b)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def number(self) -> int | None:
        b = self.take(4)
        return struct.unpack("<i", b)[0] if len(b) == 4 else None


def _tags(raw: bytes) -> list[str]:
    out, i = [], 0
    while i + 3 <= len(raw):
        tag, kind = raw[i : i + 2].decode(), chr(raw[i + 2])
        i += 3
        if kind in "ZH":
            z = raw.index(b"\0", i)
            out.append(f"{tag}:{kind}:{raw[i:z].decode()}")
            i = z + 1
        elif kind == "A":
            out.append(f"{tag}:A:{chr(raw[i])}")
            i += 1
        elif kind == "B":
            sub, n = chr(raw[i]), struct.unpack("<i", raw[i + 1 : i + 5])[0]
            form = f"<{n}{_NUMBERS[sub]}"
            values = struct.unpack(form, raw[i + 5 : i + 5 + struct.calcsize(form)])
            out.append(f"{tag}:B:{sub}," + ",".join(f"{v:g}" if sub == "f" else str(v) for v in values))
            i += 5 + struct.calcsize(form)
        else:
            form = "<" + _NUMBERS[kind]
            v = struct.unpack(form, raw[i : i + struct.calcsize(form)])[0]
            out.append(f"{tag}:{'f' if kind == 'f' else 'i'}:{v:g}" if kind == "f" else f"{tag}:i:{v}")
            i += struct.calcsize(form)
    return out


def bam_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    with open(path.removeprefix("file://"), "rb") as f:
        return _header(_Bytes(inflate(f)))


def _header(s: _Bytes) -> tuple[str, list[tuple[str, int]]]:
    if s.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = s.take(s.number()).rstrip(b"\0").decode()
    refs = []
    for _ in range(s.number()):
        name = s.take(s.number())[:-1].decode()
        refs.append((name, s.number()))
    return text, refs


def bam_record(raw: bytes, refs: list[tuple[str, int]]) -> tuple:
    rid, pos, l_name, mapq, _, n_ops, flag, l_seq, nid, npos, tlen = struct.unpack("<iiBBHHHiiii", raw[:32])
    i = 32
    name = raw[i : i + l_name - 1].decode()
    i += l_name
    ops = struct.unpack(f"<{n_ops}I", raw[i : i + 4 * n_ops])
    i += 4 * n_ops
    packed = raw[i : i + (l_seq + 1) // 2]
    i += (l_seq + 1) // 2
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq] or "*"
    qual = raw[i : i + l_seq]
    i += l_seq
    shown = "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    cigar = "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*"
    rname = refs[rid][0] if rid >= 0 else "*"
    rnext = "*" if nid < 0 else "=" if nid == rid else refs[nid][0]
    return name, flag, rname, pos + 1, mapq, cigar, rnext, npos + 1, tlen, seq, shown, _tags(raw[i:])


_SAM_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]


class _BamReader(_Reader):
    """Options ``rname``, ``begin``, ``end`` (0-based, half-open) keep the records that overlap a
    region, ``unmapped`` those without a place; the rest isn't decoded."""

    names, types = [c.split()[0] for c in schemas.SAM.split(", ")], _SAM_TYPES

    def rows(self, span: Span) -> Iterator[tuple]:
        want, lo, hi = self.options.get("rname"), int(self.options.get("begin", 0)), int(self.options.get("end", 1 << 60))
        loose = self.options.get("unmapped", "false").lower() == "true"
        with open(span.path, "rb") as f:
            s = _Bytes(inflate(f))
            _, refs = _header(s)
            ids = {n: i for i, (n, _) in enumerate(refs)}
            while (size := s.number()) is not None:
                raw = s.take(size)
                rid, pos = struct.unpack("<ii", raw[:8])
                if loose and rid >= 0:
                    continue
                if want is not None:
                    if rid != ids.get(want, -2):
                        continue
                    n_ops = struct.unpack("<H", raw[12:14])[0]
                    at = 32 + raw[8]
                    cover = sum(o >> 4 for o in struct.unpack(f"<{n_ops}I", raw[at : at + 4 * n_ops]) if _OPS[o & 15] in "MDN=X")
                    if not (pos < hi and pos + max(cover, 1) > lo):
                        continue
                yield bam_record(raw, refs)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return schemas.SAM

    def reader(self, schema: StructType) -> _BamReader:
        return _BamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats ``fastq``, ``wig`` and ``bam`` known to a session."""
    for source in (FastqSource, WigSource, BamSource):
        spark.dataSource.register(source)
