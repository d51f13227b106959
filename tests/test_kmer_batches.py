import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.operators import genome as gn


def test_counting_holds_a_bounded_number_of_windows(spark):
    """A batch of Arrow rows is counted part by part, and the parts add up."""
    rng = random.Random(51)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (5, 400, 90, 0, 3000, 41)] * 400 + [None]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    want = Counter(t[i : i + 7] for t in texts if t for i in range(len(t) - 6))
    assert {r.kmer: r.n for r in gn.kmer_counts(df, F.col("s"), 7).collect()} == dict(want)
    parts = []
    holder = type("D", (), {"select": lambda self, *a: self, "mapInArrow": lambda self, run, kind: parts.extend(run([pa.RecordBatch.from_pydict({"s": texts})])) or self, "groupBy": lambda self, *a: self, "agg": lambda self, *a: self})
    gn._counted(holder(), F.col("s"), 7)
    assert max(sum(b.column(1).to_pylist()) for b in parts) < gn.SLICE + 3000 and sum(sum(b.column(1).to_pylist()) for b in parts) == sum(want.values())
    assert len(parts) > 1
