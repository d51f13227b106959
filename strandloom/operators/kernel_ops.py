"""Kernels as DataFrame operators: pairwise alignment, likelihoods, consensus, mapping, calling, trimming.

Kernels run inside Arrow batches. The index of a reference is built by tasks, as files that the
workers map into memory (see ``reference_index``); a reference of more than ``MOST_BASES`` is
mapped to block by block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom import schemas
from strandloom.functions import cigar as cg
from strandloom.functions import sam as sm
from strandloom.kernels import aligner, alignment, assembly, fmindex, genotyping, pairhmm, poa, suffix, tails, trimming
from strandloom.operators import genome as gn
from strandloom.operators import reference_index

#: Bases of a reference block: places in an index are kept in 32 bits.
MOST_BASES = 2_000_000_000
#: Bases that two pieces of a longer chromosome share: more than two mates or a read can span.
OVERLAP = 10_000
#: Stands between a chromosome's name, a piece's first base, and the first base that belongs to the next piece.
_PIECE = "\x1f"

SAM_NAMES = [c.split()[0] for c in schemas.SAM.split(", ")]
_SAM = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Gathered rows over all shuffle partitions: kernels take long over few bytes, so partitions must not be merged by their size.

    The hash is of the keys' hash, as a partitioning by the keys themselves would be taken for the one there is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)


def align_pairs(df: DataFrame, key: str, ref: str, read: str, scoring: alignment.Scoring = alignment.NEW_DEFAULT, mode: str = "overhang") -> DataFrame:
    """``rec_key, score, begin_at, end_at, cigar, second`` of each pair; null sides count as empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = alignment.align([x or "" for x in b.column(1).to_pylist()], [x or "" for x in b.column(2).to_pylist()], scoring, mode)
            cols = [pa.array([getattr(a, n) for a in done], t) for n, t in (("score", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("cigar", pa.string()), ("second", pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["rec_key", "score", "begin_at", "end_at", "cigar", "second"])

    return df.select(key, ref, read).mapInArrow(run, f"rec_key {kind}, score long, begin_at long, end_at long, cigar string, second long")


def suffix_arrays(df: DataFrame, key: str, seq: str, k: int | None = None) -> DataFrame:
    """``rec_key, place, start_at``: the suffixes of each sequence in order, the empty one first."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(b.column(1).to_pylist()):
                order = suffix.suffix_array(s or "", k)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(order), pa.int64())), pa.array(range(len(order)), pa.int64()), pa.array(order, pa.int64())], ["rec_key", "place", "start_at"])

    return df.select(key, seq).mapInArrow(run, f"rec_key {kind}, place long, start_at long")


def find_words(df: DataFrame, key: str, seq: str, words: str) -> DataFrame:
    """``rec_key, word, places``: where each of a row's words stands in its own sequence, by a full-text index of it.

    Letters other than A, C, G and T count as A; null sequences and words have no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, asked) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                asked = [w for w in asked or [] if w]
                if text is None or not asked:
                    continue
                index = fmindex.FMIndex(text)
                low, high = index.ranges([fmindex.encode(w) for w in asked])
                places = [np.sort(index.offsets(int(x), int(y))) for x, y in zip(low, high)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(asked), pa.int64())), pa.array(asked, pa.string()), pa.array(places, pa.list_(pa.int64()))], ["rec_key", "word", "places"])

    return df.select(key, seq, words).mapInArrow(run, f"rec_key {kind}, word string, places array<long>")


def haplotype_likelihoods(reads: DataFrame, haplotypes: DataFrame, region: str = "region", strict_reference: bool = False) -> DataFrame:
    """``region, read, haplotype, lik``: capped log10 likelihoods of every read of a region given its haplotypes.

    ``reads`` has ``region, read, seq, qual``, ``haplotypes`` ``region, haplotype, seq``. A region's
    reads are gathered to one task, so regions must be bounded (tiles with reads sampled by start).
    """

    kinds = {n: d.schema[n].dataType.simpleString() for d, n in ((reads, "read"), (haplotypes, "haplotype"))}
    kind = reads.schema[region].dataType.simpleString()
    r = reads.groupBy(region).agg(F.sort_array(F.collect_list(F.struct("read", "seq", "qual"))).alias("rs"))
    h = haplotypes.groupBy(region).agg(F.sort_array(F.collect_list(F.struct("haplotype", "seq"))).alias("hs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                pairs, where, of = [], [], []
                for n, (rs, hs) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                    for k, x in enumerate(rs):
                        err = pairhmm.error_rates(x["qual"], strict_reference)
                        for y in hs:
                            pairs.append((x["seq"], err, y["seq"]))
                            where.append(n)
                            of.append((x["read"], y["haplotype"], k))
                lik = pairhmm.pair_likelihoods(pairs)
                best: dict[tuple[int, int], float] = {}
                for n, (_, _, k), v in zip(where, of, lik):
                    best[n, k] = max(best.get((n, k), -float("inf")), v)
                capped = [max(v, best[n, k] - pairhmm.CAP) for n, (_, _, k), v in zip(where, of, lik)]
                read, hap = (list(x) for x in zip(*((a, c) for a, c, _ in of))) if of else ([], [])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where, pa.int64())), pa.array(read, b.schema.field(1).type.value_type.field("read").type), pa.array(hap, b.schema.field(2).type.value_type.field("haplotype").type), pa.array(capped, pa.float64())], ["region", "read", "haplotype", "lik"])

    return _spread(r.join(h, region), region).mapInArrow(run, f"region {kind}, read {kinds['read']}, haplotype {kinds['haplotype']}, lik double")


def consensus(df: DataFrame, cluster: str, order: str, seq: str, match: int = 5, mismatch: int = -4, gap: int = -8, extend: int | None = None, local: bool = False, least_coverage: int = 0) -> DataFrame:
    """``cluster, n_seqs, consensus, msa`` of each cluster's sequences, added by ``order``.

    Null and empty sequences don't take part. A cluster is one task's work, so clusters must be bounded.
    """

    kind = df.schema[cluster].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                n, texts, rows = [], [], []
                for members in b.column(1).to_pylist():
                    seqs = [m["s_"] for m in members if m["s_"]]
                    g = poa.build(seqs, match, mismatch, gap, extend, local)
                    n.append(len(seqs))
                    texts.append(g.consensus(least_coverage))
                    rows.append(g.msa())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(texts, pa.string()), pa.array(rows, pa.list_(pa.string()))], ["cluster", "n_seqs", "consensus", "msa"])

    chosen = df.filter(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("c_")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o_"), F.col(seq).alias("s_")))).alias("members"))
    return _spread(chosen, "c_").mapInArrow(run, f"cluster {kind}, n_seqs int, consensus string, msa array<string>")


class Stretch:
    """Letters of a chromosome, read only when they are asked for as text."""

    def __init__(self, rows: DataFrame, name: str, size: int) -> None:
        self.rows, self.name, self.size = rows, name, size

    def __len__(self) -> int:
        return self.size

    def __str__(self) -> str:
        return self.rows.filter(F.col("name_") == self.name).first().s

    def __eq__(self, other: object) -> bool:
        return str(self) == str(other)


class Block(Sequence):
    """``(name, letters)`` of the chromosomes of a block; ``rows`` has them as ``name_, s``."""

    def __init__(self, rows: DataFrame, names: pa.Array | list[str], sizes: np.ndarray | list[int]) -> None:
        self.rows, self.names, self.sizes = rows, pa.array(names, pa.string()), np.asarray(sizes, np.int64)

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, i: int) -> tuple[str, Stretch]:
        name = self.names[i].as_py()
        return name, Stretch(self.rows, name, int(self.sizes[i]))

    def __eq__(self, other: object) -> bool:
        return list(self) == list(other)

    def index(self, strands: int) -> str:
        """Where the files of its index are."""
        return reference_index.build(self.rows.orderBy("name_"), self.names.to_pylist(), self.sizes.tolist(), strands)


def reference_blocks(reference: DataFrame, name: str = "name", seq: str = "seq", most: int = MOST_BASES) -> list[Block]:
    """The chromosomes in blocks of at most ``most`` bases each, by name; only names and sizes are read.

    A longer chromosome is cut into overlapping pieces, each a block of its own whose name tells
    where it begins (see ``_placed``). Two sequences of one name are an error.
    """
    clean = F.upper(F.regexp_replace(F.coalesce(F.col(seq), F.lit("")), r"\s", ""))
    whole = reference.select(F.col(name).cast("string").alias("name_"), clean.alias("s"))
    known = whole.select("name_", F.length("s").cast("long").alias("n")).filter("n > 0").orderBy("name_").toArrow().combine_chunks()
    names, sizes = (known.column(c).combine_chunks() if known.num_rows else [] for c in ("name_", "n"))
    sizes = np.asarray(sizes, np.int64)
    repeated = sorted(set(pc.filter(names[1:], pc.equal(names[1:], names[:-1])).to_pylist())) if len(names) > 1 else []
    if repeated:
        raise ValueError(f"several sequences are named {', '.join(map(str, repeated[:5]))}; name each differently")
    out, first, held = [], None, 0
    fits = np.flatnonzero(sizes <= most)

    def close(at: np.ndarray) -> None:
        chosen = names.take(pa.array(at))
        out.append(Block(whole.filter(F.col("name_").between(chosen[0].as_py(), chosen[-1].as_py()) & F.length("s").between(1, most)), chosen, sizes[at]))

    for k, i in enumerate(fits.tolist()):
        if first is not None and held + sizes[i] > most:
            close(fits[first:k])
            first = None
        if first is None:
            first, held = k, 0
        held += sizes[i]
    if first is not None:
        close(fits[first:])
    step = most - min(OVERLAP, most // 2)
    for i in np.flatnonzero(sizes > most).tolist():
        n, name_ = int(sizes[i]), names[i].as_py()
        for begin in range(0, n - (most - step), step):
            owned = begin + step if begin + most < n else n
            piece = f"{name_}{_PIECE}{begin}{_PIECE}{owned}"
            out.append(Block(whole.filter(F.col("name_") == name_).select(F.lit(piece).alias("name_"), F.substr("s", F.lit(begin + 1), F.lit(most)).alias("s")), [piece], [min(most, n - begin)]))
    return out


def _placed(rname: str | None, pos: int | None) -> tuple[str | None, int | None, bool]:
    """(chromosome, 1-based place, whether it belongs to this piece) of a place in a block."""
    if not rname or _PIECE not in rname:
        return rname, pos, True
    name, first, owned = rname.split(_PIECE)
    return name, pos + int(first), pos + int(first) <= int(owned)


def map_small_rna(reads: DataFrame, reference: DataFrame, options: tails.Options = tails.Options()) -> DataFrame:
    """SAM rows of ``name, seq, qual`` reads; a row for each hit.

    Over several blocks of a large reference a read keeps the hits of the blocks with its best
    match (see ``tails.Mapped.rank``); its hits are counted over them for ``most_hits`` and NH.
    """
    found, blocks = None, reference_blocks(reference)
    key = ["qname", "seq_", "qual_"]
    more = {"seq_": pa.string(), "qual_": pa.string(), "rank_": pa.list_(pa.int32()), "found_": pa.int64(), "strand_": pa.int64(), "block_": pa.int32()}
    for n, block in enumerate(blocks):
        at = block.index(strands=2)

        def run(batches: Iterator[pa.RecordBatch], at=at, n=n) -> Iterator[pa.RecordBatch]:
            shared = reference_index.both_strands(at)
            for b in batches:
                for i in range(0, b.num_rows, 2000):
                    part = b.slice(i, 2000)
                    triples = list(zip(*(["" if x is None else x for x in part.column(c).to_pylist()] for c in range(3))))
                    out = []
                    for pair, (_, seq, qual) in zip(tails.map_reads(shared, triples, options), triples):
                        for m in pair:
                            rows = [(r, _placed(r[2], r[3])) for r in tails.sam_rows(m)]
                            own = [(*r[:2], name, pos, *r[4:]) for r, (name, pos, mine) in rows if mine]
                            twice = len(rows) - len(own)  # found in the next piece too
                            out += [(*r, seq, qual, m.rank, m.found - twice, len(m.hits) - twice, n) for r in own]
                        # a read with too many hits here still counts against other blocks
                        if (m := pair[0]).found > options.most_hits:
                            out.append((m.name, 0, None, *[None] * 8, None, seq, qual, m.rank, m.found, 0, n))
                    yield _batch(out, [*_SAM, *more.values()], [*SAM_NAMES, *more])

        rows = reads.select("name", "seq", "qual").mapInArrow(run, schemas.SAM + ", seq_ string, qual_ string, rank_ array<int>, found_ long, strand_ long, block_ int")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return reads.sparkSession.createDataFrame([], schemas.SAM)
    if len(blocks) == 1:
        return found.filter("rname is not null").select(*SAM_NAMES)
    best = found.groupBy(*key).agg(F.min("rank_").alias("best_"))
    kept = found.join(best, key).filter("rank_ = best_")
    sides = {"forward_": F.col("flag") == 0, "reverse_": F.col("flag") == 16}
    each = kept.groupBy(*key, "block_").agg(F.max("found_").alias("found_"), *[F.max(F.when(x, F.col("strand_"))).alias(k) for k, x in sides.items()])
    total = each.groupBy(*key).agg(F.sum("found_").alias("total_"), *[F.sum(k).alias(k) for k in sides], *[F.min(F.when(F.col(k) > 0, F.col("block_"))).alias(f"first_{k}") for k in sides])
    kept = kept.join(total, key).filter((F.col("total_") <= options.most_hits) & F.col("rname").isNotNull())
    side = lambda name: F.when(sides["forward_"], F.col(f"{name}forward_")).otherwise(F.col(f"{name}reverse_"))
    number = F.lit(1) if options.adapter5 else side("")
    if options.adapter5:  # only the first hit of a strand is taken on
        kept = kept.filter(F.col("block_") == side("first_"))
    tags = F.concat(F.array(F.concat(F.lit("NH:i:"), number.cast("string"))), F.expr("slice(optionals, 2, size(optionals))"))
    return kept.withColumn("optionals", tags).select(*SAM_NAMES)


def map_pairs(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """SAM rows, two for each pair ``name, seq1, qual1, seq2, qual2``.

    Over several blocks of a large reference a pair keeps the block with the greatest sum of scores.
    """
    found = None
    for n, block in enumerate(reference_blocks(reference)):
        at = block.index(strands=1)

        def run(batches: Iterator[pa.RecordBatch], at=at, n=n) -> Iterator[pa.RecordBatch]:
            shared = reference_index.paired_genome(at)
            for b in batches:
                for i in range(0, b.num_rows, 500):
                    part = b.slice(i, 500)
                    cols = [["" if x is None else x for x in part.column(c).to_pylist()] for c in range(5)]
                    done = aligner.map_pairs(shared, [((q, s, t), (q, u, v)) for q, s, t, u, v in zip(*cols)])
                    rows = []
                    for r in (r for p in done for r in p):
                        name, pos, _ = _placed(r[2], r[3])
                        mate, next_, _ = _placed(r[2] if r[6] == "=" else r[6], r[7])
                        rows.append((*r[:2], name, pos, *r[4:6], "=" if r[6] == "=" else mate, next_, *r[8:], n))
                    yield _batch(rows, [*_SAM, pa.int32()], [*SAM_NAMES, "block_"])

        rows = pairs.select("name", "seq1", "qual1", "seq2", "qual2").mapInArrow(run, schemas.SAM + ", block_ int")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return pairs.sparkSession.createDataFrame([], schemas.SAM)
    if n == 0:
        return found.drop("block_")
    score = F.coalesce(F.regexp_extract(F.array_join("optionals", ";"), r"AS:i:(\d+)", 1).try_cast("long"), F.lit(0))
    sums = found.groupBy("qname", "block_").agg(F.sum(score).alias("s_")).groupBy("qname").agg(F.max_by("block_", F.struct("s_", -F.col("block_"))).alias("b_")).withColumnRenamed("qname", "q_")
    return found.join(sums, (F.col("qname") == F.col("q_")) & (F.col("block_") == F.col("b_"))).drop("q_", "b_", "block_")


#: Width of a tile and of its padding on either side.
TILE = 100


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every tile's stretch of the reference with a tile on either side, cut in one pass over each sequence."""
    for b in batches:
        for name, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py()
            n = max(-(-(len(text) - TILE) // TILE), 1)
            for first in range(0, n, 10_000):
                at = range(first, min(n, first + 10_000))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array([text[i * TILE : (i + 3) * TILE] for i in at], pa.string())], ["r_", "tile_", "window"])


def call_variants(alignments: DataFrame, reference: DataFrame, per_start: int = 5, strict_reference: bool = False) -> DataFrame:
    """``chrom, pos, ref, alt, qual, genotype, gq, pl``: variants by local assembly, tile by tile.

    Reads are filtered, sampled by start (the same ones at every run), and sent to the tiles they
    begin in; a tile's work is bounded by the sampling. ``reference`` has ``name, seq``.
    """
    c = F.col
    good = alignments.filter(~sm.low_mapping_quality(c("mapq")) & ~sm.duplicate(c("flag")) & ~sm.secondary(c("flag")) & ~sm.too_short(c("seq")) & ~sm.mate_elsewhere(c("rnext")) & (c("cigar") != "*") & (c("qual") != "*"))
    kept = gn.sampled(good, ["rname", "pos"], F.struct(F.xxhash64("qname"), "qname", "flag"), per_start).withColumn("steps", cg.parse(c("cigar")))
    reverse = sm.has_flag(c("flag"), "read_reverse_strand")
    fixed = kept.withColumn("x", sm.revert_soft_clips(c("pos"), c("steps"), c("seq"), c("qual"), reverse))
    rows = fixed.select("rname", (c("x.pos") - 1).alias("begin"), sm.end(c("x.pos"), c("x.steps")).alias("end"), sm.hard_clip(c("x.seq"), c("x.steps")).alias("seq"), sm.hard_clip(c("x.qual"), c("x.steps")).alias("qual"), "qname")
    tiled = gn.tiles(rows, "begin", None, TILE).groupBy("rname", "tile").agg(F.collect_list(F.struct("begin", "end", "seq", "qual", "qname")).alias("reads"))
    text = F.upper(F.regexp_replace("seq", r"\s", ""))
    ref = reference.select("name", text.alias("t_")).filter("t_ is not null").mapInArrow(_windows, "r_ string, tile_ long, window string")
    work = tiled.join(ref, (c("rname") == c("r_")) & (c("tile") == c("tile_"))).select("rname", "tile", "window", "reads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for chrom, tile, window, reads in zip(*(b.column(i).to_pylist() for i in range(4))):
                offset = tile * TILE
                inside = []
                for r in sorted(reads, key=lambda r: (r["begin"], r["qname"], r["seq"])):
                    lo, hi = max(offset - r["begin"], 0), max(0, r["end"] - offset - len(window))
                    seq, qual = r["seq"][lo : len(r["seq"]) - hi], r["qual"][lo : len(r["qual"]) - hi]
                    if len(seq) >= 10:
                        inside.append((seq, qual, r["begin"], r["end"]))
                haps = assembly.assemble_haplotypes([(s, q) for s, q, *_ in inside], window)
                if len(haps) < 2:
                    continue
                lik = pairhmm.capped(pairhmm.log10_likelihoods([(s, pairhmm.error_rates(q, strict_reference)) for s, q, *_ in inside], [h.seq for h in haps]))
                keep = pairhmm.well_modelled(lik, [len(s) for s, *_ in inside], strict_reference)
                spans = [(x[2], x[3]) for x, k in zip(inside, keep) if k]
                for v in genotyping.call_region(haps, spans, lik[keep], window, offset, offset + TILE, offset + 2 * TILE):
                    out.append((chrom, v.begin + 1, v.alleles[0], v.alleles[1:], v.qual, f"{v.genotype[0]}|{v.genotype[1]}", v.gq, v.pls))
            yield _batch(out, [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.string(), pa.int32(), pa.list_(pa.int32())], ["chrom", "pos", "ref", "alt", "qual", "genotype", "gq", "pl"])

    return _spread(work, "rname", "tile").mapInArrow(run, "chrom string, pos long, ref string, alt array<string>, qual double, genotype string, gq int, pl array<int>")


def detect_adapters(pairs: DataFrame, options: trimming.Options = trimming.Options(), sensitive: bool = False) -> tuple[str, str]:
    """From the pairs with the smallest name hashes, ``pairs_for_detection`` at most (the documented bound)."""
    chosen = pairs.select(F.xxhash64("name").alias("h"), "seq1", "seq2").orderBy("h", "seq1", "seq2").limit(options.pairs_for_detection).toPandas()
    cut = [(trimming.prepare(a or "", "", min(len(a or ""), len(b or "")))[0], trimming.prepare(b or "", "", min(len(a or ""), len(b or "")))[0]) for a, b in zip(chosen.seq1, chosen.seq2)]
    return trimming.detect(cut, options, sensitive)


def trim_pairs(pairs: DataFrame, adapters: tuple[str, str], options: trimming.Options = trimming.Options()) -> DataFrame:
    """``name, seq1, qual1, seq2, qual2, kept``: both mates cut to their insert."""
    names = ["name", "seq1", "qual1", "seq2", "qual2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, s, q, t, r in zip(*(b.column(i).to_pylist() for i in range(5))):
                f, m, kept = trimming.trim_pair((s or "", q or ""), (t or "", r or ""), adapters, options)
                out.append((n, *f, *m, kept))
            yield _batch(out, [pa.string()] * 5 + [pa.int32()], [*names, "kept"])

    return pairs.select(*names).mapInArrow(run, "name string, seq1 string, qual1 string, seq2 string, qual2 string, kept int")


def trim_single(reads: DataFrame, key: str, adapter: str, seq: str = "seq", error: float = 0.1, least: int = 5) -> DataFrame:
    """``rec_key, kept``: how much of each read stands before the adapter."""
    kind = reads.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([trimming.single_end((s or "").upper(), adapter, error, least=least) for s in b.column(1).to_pylist()], pa.int32())], ["rec_key", "kept"])

    return reads.select(key, seq).mapInArrow(run, f"rec_key {kind}, kept int")


def allele_frequencies(df: DataFrame, key: str, liks: str, alleles: str) -> DataFrame:
    """``rec_key, log10_no_variant, counts`` of loci with genotype likelihoods in VCF order."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [genotyping.allele_frequencies(g, a) for g, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(d[0]) for d in done], pa.float64()), pa.array([d[1] for d in done], pa.list_(pa.float64()))], ["rec_key", "log10_no_variant", "counts"])

    return df.select(key, liks, alleles).mapInArrow(run, f"rec_key {kind}, log10_no_variant double, counts array<double>")
