"""Mixing sources to target shares of all tokens.

Each document has a fixed hash. A source's partial pass takes the documents whose hash is below a
threshold, so a larger budget always takes a superset. The threshold is found from histograms of
tokens by source and hash bucket: the bucket in which the budget runs out is cut into buckets
again, and only its documents are counted then. Nothing is sorted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.storage import materialise

#: Vocabulary (ranks of byte pairs) and the pattern that parts words; both are parameters.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bits of the hash used by each round of histograms.
BITS = 12
ROUNDS = 4


@cache
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``*keep, tokens``: the tokens of each whole text; 0 for null and empty ones."""
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, "tokens"])

    return df.select(*keep, F.col(text).alias("text_")).mapInArrow(run, ", ".join([*fields, "tokens long"]))


def _part(round_: int):
    """The bucket of a hash in this round's histogram: its next bits from the top."""
    return F.shiftrightunsigned("mix_hash", 64 - BITS * (round_ + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) for ``docs`` (``doc_id, source, tokens``) and ``targets`` (``source,
    target_share, max_repeats``).

    The mixture is meant to have ``budget`` tokens, by default as many as the documents of the
    sources with a target. A source of T tokens and budget B is used floor(B / T) times whole and
    once more in part, ``max_repeats`` times in all at most. ``uses`` has ``doc_id, source, tokens,
    n_used`` for every document, 0 for those of sources without a target; ``shares`` has ``source,
    target_share, max_repeats, n_docs, available, wanted, used, share, met`` for every source of
    either table. A partial pass stops at the last document that fits the budget; ``met`` says that
    the cap didn't keep the source from its budget.

    Null sources are a source without target. Documents of 0 tokens go with their hash. Rows with
    equal ids are taken or left together. Of several targets of one source the largest share holds;
    null shares and repeats count as 0. With no documents or no targets nothing is used.
    """
    docs = docs.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.xxhash64("doc_id").alias("mix_hash"))
    targets = targets.filter("source is not null").groupBy("source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max_by(F.coalesce("max_repeats", F.lit(0)), F.coalesce("target_share", F.lit(0.0))).alias("max_repeats")
    )
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("available"))
    plan = sizes.withColumnRenamed("source", "has").join(targets, F.col("has") == F.col("source"), "full")
    plan = plan.select(F.coalesce("source", "has").alias("source"), "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("available", F.lit(0)).alias("available"))
    total = plan.filter("target_share > 0").agg(F.sum("available")).scalar() if budget is None else F.lit(int(budget)).cast("long")
    plan = plan.withColumn("budget", total)
    wanted = F.coalesce(F.round(F.col("target_share") * F.col("budget")).cast("long"), F.lit(0))
    plan = plan.withColumn("wanted", wanted)
    whole = F.when(F.col("available") > 0, F.least(F.expr("wanted div nullif(available, 0)"), F.col("max_repeats").cast("long"))).otherwise(0)
    plan = plan.withColumn("passes", F.coalesce(whole, F.lit(0)))
    rest = F.when(F.col("passes") < F.col("max_repeats"), F.greatest(F.col("wanted") - F.col("passes") * F.col("available"), F.lit(0))).otherwise(0)
    plan = materialise(plan.withColumn("rest", F.coalesce(rest, F.lit(0))), "plan")

    left = plan.filter("rest > 0 and available > 0").select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("edge"))
    inside = docs.join(left, "source")
    for r in range(ROUNDS):
        histogram = inside.groupBy("source", "left", "edge", _part(r).alias("part")).agg(F.sum("tokens").alias("n"))
        by = Window.partitionBy("source").orderBy("part")
        upto = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))
        # the first bucket that doesn't fit as a whole
        over = histogram.withColumn("upto", upto).filter("upto > left").groupBy("source").agg(F.min_by(F.struct("left", "edge", "part", "upto", "n"), "part").alias("x"))
        step = F.shiftleft(F.col("x.part"), 64 - BITS * (r + 1))
        edges = over.select("source", (F.col("x.left") - F.col("x.upto") + F.col("x.n")).alias("left"), F.col("x.edge").bitwiseOR(step).alias("edge"), F.col("x.part").alias("at"))
        edges = materialise(edges, "edges")
        inside = inside.drop("left", "edge").withColumn("part_", _part(r)).join(edges, "source").filter("part_ = at").drop("part_", "at")
    # hashes compare as unsigned numbers
    flip = F.lit(-(1 << 63))
    edge = edges.select("source", F.col("edge").bitwiseXOR(flip).alias("below"))
    chosen = docs.withColumnRenamed("source", "of").join(plan.select("source", "passes", "rest", "max_repeats").join(edge, "source", "left"), F.col("of") == F.col("source"), "left")
    once = F.when((F.col("rest") > 0) & (F.col("below").isNull() | (F.col("mix_hash").bitwiseXOR(flip) < F.col("below"))), 1).otherwise(0)
    uses = chosen.select("doc_id", F.col("of").alias("source"), "tokens", (F.coalesce("passes", F.lit(0)) + once).cast("long").alias("n_used"))

    spent = uses.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("tokens") * F.col("n_used")).alias("used"))
    shares = plan.join(spent, F.col("of").eqNullSafe(F.col("source")), "left").withColumn("used", F.coalesce("used", F.lit(0)))
    shares = shares.withColumn("all_used", spent.agg(F.sum("used")).scalar())
    share = F.when(F.col("all_used") > 0, F.col("used") / F.col("all_used")).otherwise(0.0)
    met = F.col("available") * F.coalesce("max_repeats", F.lit(0)) >= F.col("wanted")
    shares = shares.select("source", "target_share", "max_repeats", "n_docs", "available", "wanted", "used", share.alias("share"), F.coalesce(met, F.lit(True)).alias("met"))
    return uses, shares
