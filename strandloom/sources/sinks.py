"""Writers: FASTA, FASTQ, delimited lines with headers, BAM parts, references, variants."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.sources.streams import _BASES, _OPS

#: Fixed value: the empty block that ends a BGZF file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def fasta_text(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def fastq_text(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def delimited(df: DataFrame, strict_reference: bool = False) -> DataFrame:
    """``value``: the columns joined by tabs, arrays spread out; with a tab at the end on request."""
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may hold anything
    cols = [F.array_join(c, "\t") if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]
    line = F.concat_ws("\t", *[F.when(c != "", c) if t.startswith("array") else c for c, (_, t) in zip(cols, df.dtypes)])
    return df.select((F.concat(line, F.lit("\t")) if strict_reference else line).alias("value"))


def write_fasta(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(fasta_text(F.col("name"), F.col("seq"))).write.mode(mode).text(path)


def write_fastq(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(fastq_text(F.col("name"), F.col("seq"), F.col("qual"))).write.mode(mode).text(path)


def write_lines(df: DataFrame, path: str, header: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Delimited records; every part file begins with the header lines, so each is whole by itself."""
    body = delimited(df)
    if header:
        top = "\n".join(header)

        def headed(batches):
            import pyarrow as pa

            fresh = True
            for b in batches:
                if fresh and b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([top])], ["value"])
                    fresh = False
                yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

        body = body.mapInArrow(headed, "value string")
    body.write.mode(mode).text(path)


def save_reference(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A reference's sequences with two bits a base in ``packed`` and its N runs beside."""
    from strandloom.operators.genome import unknown_runs

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in b.column(1).to_pylist()], pa.int64()), pa.array([pack2(s) for s in b.column(1).to_pylist()], pa.binary())], ["name", "length", "packed"])

    df.select("name", "seq").mapInArrow(pack, "name string, length long, packed binary").write.mode(mode).parquet(f"{path}/sequences")
    unknown_runs(df, "name", "seq").write.mode(mode).parquet(f"{path}/unknown")


def load_reference(spark, path: str) -> DataFrame:
    """``name, seq`` with N where its runs were."""
    from strandloom.functions.seq import with_runs

    def unpack(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unpack2(p, n) for p, n in zip(b.column(2).to_pylist(), b.column(1).to_pylist())])], ["name", "seq"])

    s = spark.read.parquet(f"{path}/sequences").mapInArrow(unpack, "name string, seq string")
    runs = spark.read.parquet(f"{path}/unknown").groupBy(F.col("rec_key").alias("name")).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return s.join(runs, "name", "left").select("name", with_runs(F.col("seq"), F.coalesce("runs", none)).alias("seq"))


def pack2(seq: str) -> bytes:
    """Two bits a base, first base lowest; others than A, C, G, T as A."""
    import numpy as np

    code = np.zeros(-(-len(seq) // 4) * 4, np.uint8)
    table = np.zeros(256, np.uint8)
    for i, c in enumerate("ACGT"):
        table[ord(c)] = table[ord(c.lower())] = i
    code[: len(seq)] = table[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    four = code.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def unpack2(raw: bytes, length: int) -> str:
    import numpy as np

    b = np.frombuffer(raw, np.uint8)
    code = np.stack([(b >> s) & 3 for s in (0, 2, 4, 6)], axis=1).ravel()[:length]
    return np.frombuffer(b"ACGT", np.uint8)[code].tobytes().decode()


# BAM


def _block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bin(begin: int, end: int) -> int:
    """The smallest of the nested bins that holds an interval."""
    end -= 1
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return base + (begin >> shift)
    return 0


def _tag(text: str) -> bytes:
    tag, kind, value = text.split(":", 2)
    head = tag.encode()
    if kind == "i":
        return head + b"i" + struct.pack("<i", int(value))
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "A":
        return head + b"A" + value[:1].encode()
    if kind == "B":
        sub, *items = value.split(",")
        form = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[sub]
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(items)}{form}", len(items), *(float(x) if sub == "f" else int(x) for x in items))
    return head + kind.encode() + value.encode() + b"\0"


def bam_bytes(r, ids: dict[str, int]) -> bytes:
    import re

    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"] or "")]
    seq = "" if r["seq"] in (None, "*") else r["seq"]
    qual = r["qual"]
    rid = ids.get(r["rname"], -1)
    nid = rid if r["rnext"] == "=" else ids.get(r["rnext"], -1)
    pos = int(r["pos"] or 0) - 1
    span = sum(n for n, o in ops if o in "MDN=X")
    name = (r["qname"] or "*").encode() + b"\0"
    code = [_BASES.index(c) if c in _BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(code[::2], code[1::2]))
    quals = bytes([255] * len(seq)) if qual in (None, "*") or len(qual) != len(seq) else bytes(ord(c) - 33 for c in qual)
    body = struct.pack("<iiBBHHHiiii", rid, pos, len(name), int(r["mapq"] or 0), _bin(max(pos, 0), max(pos, 0) + max(span, 1)), len(ops), int(r["flag"] or 0), len(seq), nid, int(r["pnext"] or 0) - 1, int(r["tlen"] or 0))
    body += name + struct.pack(f"<{len(ops)}I", *(n << 4 | _OPS.index(o) for n, o in ops)) + packed + quals + b"".join(map(_tag, r["optionals"] or []))
    return struct.pack("<i", len(body)) + body


def write_bam(df: DataFrame, path: str, references: list[tuple[str, int]], header: str = "@HD\tVN:1.6\n") -> None:
    """One BAM file for each partition in a shared folder; a task that runs again writes the same name anew."""
    from pyspark import TaskContext

    folder = path.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    ids = {n: i for i, (n, _) in enumerate(references)}
    text = header.encode()
    top = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))
    for n, size in references:
        top += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)

    def save(rows: Iterator) -> None:
        part = TaskContext.get().partitionId()
        final, now = (os.path.join(folder, f"{p}part-{part:05d}.bam") for p in ("", f".{TaskContext.get().taskAttemptId()}-"))
        with open(now, "wb") as f:
            held = top
            for r in rows:
                held += bam_bytes(r, ids)
                while len(held) >= 60_000:
                    f.write(_block(held[:60_000]))
                    held = held[60_000:]
            f.write(_block(held) if held else b"")
            f.write(BGZF_END)
        os.replace(now, final)

    df.foreachPartition(save)
