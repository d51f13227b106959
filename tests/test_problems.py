import random
import re
import statistics
from collections import defaultdict

import pytest

from strandloom.operators import periods, rejects, skew
from tests.conftest import rows


def test_key_statistics_against_python(spark):
    rng = random.Random(3)
    data = [("hot", rng.randint(1, 40)) for _ in range(900)] + [("hot", 7)] * 500 + [(rng.choice("abc"), rng.choice([None, *range(9)])) for _ in range(300)] + [(None, 5), (None, None), ("only_null", None)]
    df = spark.createDataFrame([(k, p, "x") for k, p in data], "k string, p long, n string")
    by = defaultdict(list)
    for k, p in data:
        by[k].append(p)
    want = []
    for k, ps in by.items():
        known = [p for p in ps if p is not None]
        want.append((k, len(ps), len(set(known)), float(statistics.median(known)) if known else None))
    got = rows(skew.key_statistics(df, "k", "p", 6).drop("n_partitions"))
    assert got == sorted(want, key=str)
    assert {r.k: r.n_partitions for r in skew.key_statistics(df, "k", "p", 6).collect()}["hot"] > 1
    assert rows(skew.heavy_keys(skew.key_statistics(df, "k", "p"), 0.5).select("k")) == [("hot",)]


def test_key_statistics_empty(spark):
    df = spark.createDataFrame([], "k string, p long")
    assert rows(skew.key_statistics(df, "k", "p")) == []


def test_usual_name(spark):
    contigs = spark.createDataFrame([("1", "chr1"), ("CHR1", "chr1")], "spelling string, chrom string")
    df = spark.createDataFrame([(" 1",), ("CHR1 ",), ("odd",), (None,), (" ",)], "chrom string")
    from pyspark.sql import functions as F

    assert rows(skew.usual_name(F.col("chrom"), contigs, df).select("usual")) == sorted([("chr1",), ("chr1",), ("odd",), (None,), (None,)], key=str)


def brute_periods(data):
    by, out = defaultdict(list), []
    for k, s, e in data:
        if k is not None and s is not None and e is not None and s >= 0 and e > s:
            by[k].append((s, e))
    for k, xs in by.items():
        merged = []
        for s, e in sorted(xs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for i, (s, e) in enumerate(merged):
            out.append((k, s, e, merged[i + 1][0] if i + 1 < len(merged) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [1, 7, 50, 1 << 16])
def test_merge_periods(spark, tile):
    rng = random.Random(tile)
    data = [("hot", s := rng.randint(0, 3000), s + rng.choice([1, 2, 5, 40])) for _ in range(400)]
    data += [(rng.choice(["a", "b", None]), s := rng.randint(-5, 300), s + rng.randint(-3, 30)) for _ in range(200)]
    data += [("t", 0, 10), ("t", 10, 20), ("t", 0, 10), ("t", 21, 22), ("n", None, 5), ("n", 5, None), ("far", 10, 2_000_000_000), ("far", 5_000_000_000, 5_000_000_001), ("far", 1_000, 2_000)]
    df = spark.createDataFrame([(k, s, e, 1) for k, s, e in data], "g string, s long, e long, tile int")
    got = periods.merge_periods(df, ["g"], "s", "e", tile=tile)
    assert rows(got) == brute_periods(data)
    assert rows(periods.gaps(got)) == sorted([(k, e, n) for k, _, e, n in brute_periods(data) if n is not None], key=str)


def test_merge_periods_empty(spark):
    assert rows(periods.merge_periods(spark.createDataFrame([], "g string, s long, e long"), ["g"], "s", "e")) == []


CONTIGS = [("chr1", "chr1", 1000), ("1", "chr1", 1000), ("chr2", "chr2", 500)]


def judge(kind, line, n_cols):
    """The rules again, in plain Python."""
    if line is None:
        return None
    if line.endswith("\r"):
        line = line[:-1]
    if line.endswith("\t"):
        line = line[:-1]
    if not line.strip() or line.startswith({"vcf": ("#", "track", "browser"), "bed": ("#", "track", "browser"), "sam": "@"}[kind]):
        return None
    fields, i = [], 0
    if kind == "sam":
        fields = line.split("\t")
    else:
        while True:
            if line[i : i + 1] == '"':
                m = re.compile(r'"((?:[^"]|"")*)"(?=\t|\Z)').match(line, i)
                if not m:
                    return "quoting"
                fields.append(m[1].replace('""', '"'))
                i = m.end()
            else:
                j = line.find("\t", i)
                j = len(line) if j < 0 else j
                fields.append(line[i:j])
                i = j
            if i >= len(line):
                break
            i += 1
    if (len(fields) < 11) if kind == "sam" else (len(fields) != n_cols):
        return "column_count"
    size = {s: n for s, _, n in CONTIGS}
    num = lambda x, lo, hi: re.fullmatch("[0-9]+", x) is not None and lo <= int(x) <= hi
    u = 2**32 - 1
    if kind == "vcf":
        ok = fields[0] in size and num(fields[1], 1, size[fields[0]]) and re.fullmatch("[ACGTNacgtn]+", fields[3]) and re.fullmatch(r"\.|[0-9]+(\.[0-9]+)?", fields[5])
    elif kind == "sam":
        ok = num(fields[1], 0, 4095) and (fields[2] == "*" or fields[2] in size) and num(fields[3], 0, u) and num(fields[4], 0, 255) and re.fullmatch(r"\*|([0-9]+[MIDNSHP=X])+", fields[5])
        ok = ok and (fields[10] == "*" or (re.fullmatch("[!-~]*", fields[10]) and (fields[9] == "*" or len(fields[9]) == len(fields[10]))))
    else:
        ok = fields[0] in size and num(fields[1], 0, u) and num(fields[2], 0, u) and int(fields[2]) >= int(fields[1])
        ok = ok and (len(fields) < 6 or (num(fields[4], 0, 1000) and fields[5] in "+-." and fields[5]))
    return None if ok else "value"


def test_rejects_against_python(spark):
    rng = random.Random(5)
    cells = ["chr1", "1", "chr9", "", "0", "5", "007", "999", "1001", "-3", "12345678901234567890123456789012345678901234", "4294967295", "4294967296", "A", "acgtn", "AX", ".", "3.5", "3.", '"', '"a"', '"a\tb"', '"a""b"', 'x"y', '"a', '""', '"a"b', "+", "*", "3M", "3M2", "IIII", "ACGT", "!~", "٣"]
    good = {"vcf": ["chr1", "5", ".", "A", "T", ".", "PASS", "x"], "bed": ["chr1", "5", "9", '"a""\tb"', "7", "+"], "sam": ["q", "4", "*", "0", "0", "*", "*", "0", "0", "ACGT", "IIII"]}
    lines, want, n = [], [], 0
    for kind, base in good.items():
        if kind != "sam":
            lines.append((n, kind, kind, 0, "#" + "\t".join("c" * len(base)) + "\r", "x"))
            n += 1
        for _ in range(400):
            f = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                f[rng.randrange(len(f))] = rng.choice(cells)
            if rng.random() < 0.1:
                f.pop()
            if rng.random() < 0.1:
                f.append(rng.choice(cells))
            line = "\t".join(f) + rng.choice(["", "", "\r", "\t", "\t\r", "\t\t"])
            lines.append((n, kind, kind, n, line, "x"))
            if r := judge(kind, line, len(base)):
                want.append((n, r))
            n += 1
    lines += [(n, "vcf", "vcf", n, None, "x"), (n + 1, "bed", "bed", n, "  ", "x"), (n + 2, "odd", "o", 1, "what", "x"), (n + 3, "bed", "bed", n, "track x", "x"), (n + 4, "sam", "sam", n, "@x", "x"), (n + 5, None, None, None, "z", "x")]
    rng.shuffle(lines)
    df = spark.createDataFrame(lines, "line_id long, file_kind string, file_name string, line_no int, line string, value string")
    contigs = spark.createDataFrame(CONTIGS, "spelling string, chrom string, length_bp long")
    valid, rejected = rejects.judge_lines(df, contigs)
    assert rows(rejected.select("line_id", "reason")) == sorted(want, key=str)
    bad = {i for i, _ in want}
    assert valid.count() + len(bad) == 1200
    typed = rejects.typed_records(valid, "bed").collect()
    assert any(r.name == 'a"\tb' for r in typed) and all(r.end_pos >= r.start_pos for r in typed)


def test_rejects_empty(spark):
    df = spark.createDataFrame([], "line_id long, file_kind string, file_name string, line_no int, line string")
    contigs = spark.createDataFrame([], "spelling string, chrom string, length_bp long")
    valid, rejected = rejects.judge_lines(df, contigs)
    assert rows(valid) == [] and rows(rejected) == []


def test_very_long_line(spark):
    line = "chr1\t1\t2\t" + '"' + 'x""' * 300_000 + '"'
    df = spark.createDataFrame([(1, "bed", "f", 0, "#a\tb\tc\td"), (2, "bed", "f", 1, line)], "line_id long, file_kind string, file_name string, line_no int, line string")
    contigs = spark.createDataFrame(CONTIGS, "spelling string, chrom string, length_bp long")
    assert rows(rejects.judge_lines(df, contigs)[1]) == []


def test_clear(spark):
    from strandloom import storage

    storage.clear(spark)
    df = storage.materialise(spark.range(3), "x")
    assert df.count() == 3 and storage.clear(spark) == 1 and storage.clear(spark) == 0
