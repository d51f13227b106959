"""Queries over whole tables against brute force."""

import random

import __spark_entry__ as entry


def saved(spark, folder, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def test_variant_consensus_whole(spark, tmp_path):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    size = {"c1": 1000, "c2": 500, "c3": 300}
    spelled = {"c1": "c1", "1": "c1", "c2": "c2", "c3": "c3"}
    seqs = {i: word(rng.randint(5, 300)) for i in range(1, 60)}
    made = []
    for i in range(1500):
        chrom = rng.choice(["c1", "1", " 1", "c1 ", "c2", "c3", "other", None])
        most = size[spelled[chrom.strip()]] if chrom and chrom.strip() in spelled else 9
        made.append((i, chrom, rng.choice([None, *range(1, most + 1)]), rng.choice(["A", "cc", "GATC", ".", None]), rng.choice(["T", ".", "GG,A", None]), 1))
    again = [(i, "c2", 1, "A", "T", 2) for i, *_ in made[:300]]
    d = saved(
        spark, tmp_path,
        contig_names=([(k, v, size[v]) for k, v in spelled.items()], "spelling string, chrom string, length_bp long"),
        fasta_records=([(i, s[:4].lower() + "\n" + s[4:]) for i, s in seqs.items()] + [(60, None), (61, "")], "rec_id long, seq string"),
        vcf_variants=(made + again, "var_id long, chrom string, pos long, ref string, alt string, loaded_at long"),
    )
    want = {}
    for k, c in enumerate(sorted(size)):
        seq = "".join(seqs[i] for i in sorted(seqs) if i % 3 == k)
        hits = {((p - 1) * len(seq) // size[c] + 1, r.upper().replace(".", ""), a.split(",")[0].replace(".", "")) for _, x, p, r, a, _ in made if x and spelled.get(x.strip()) == c and None not in (p, r, a)}
        out, at = "", 0
        for p, r, a in sorted(hits):
            if p - 1 >= at:
                out, at = out + seq[at : p - 1] + a, p - 1 + len(r)
        want[c] = out + seq[at:]
    got = entry.queries()["variant_consensus_whole"](spark, d)
    assert {r.chrom: r.seq for r in got.collect()} == want


def test_expression_of_whole_genes(spark, tmp_path):
    rng = random.Random(6)
    data = [(rng.choice("+-"), rng.choice(["miRNA", "tRNA"]), f"Nix{rng.randint(1, 40)}", b := rng.randint(0, 50), b + rng.randint(1, 90)) for _ in range(900)]
    d = saved(spark, tmp_path, bedsix_genes=(data, "strand string, gene_type string, gene_name string, start_pos long, end_pos long"))
    m = {}
    for strand, kind, name, b, e in data:
        m[strand, f"{kind}/{name}"] = m.get((strand, f"{kind}/{name}"), 0) + e - b
    q = entry.queries()
    genes = {g for _, g in m}
    assert len(genes) > 70
    got = {(r["sample"], r.gene): r.value for r in q["expression_filled"](spark, d).collect()}
    assert got == {(s, g): m.get((s, g), 0) for s in "+-" for g in genes}
    ranked = {s: sorted((got[s, g], g) for g in genes) for s in "+-"}
    mean = [(x[0] + y[0]) / 2 for x, y in zip(ranked["+"], ranked["-"])]
    for r in q["expression_quantile_normalised"](spark, d).collect():
        at = [k for k, (v, _) in enumerate(ranked[r["sample"]]) if v == r.value]
        assert abs(r.normalised - sum(mean[k] for k in at) / len(at)) < 1e-5


def test_ranked_within_has_a_heavy_key_in_several_tasks(spark):
    from pyspark.sql import functions as F

    from strandloom.operators import order

    rng = random.Random(7)
    data = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(30)])) for i in range(800)]
    df = spark.createDataFrame(data, "id long, k string, v long").repartition(5)
    place = {}
    for k in ("a", "b", None):
        for n, x in enumerate(sorted((x for x in data if x[1] == k), key=lambda x: (x[2] is not None, x[2] or 0, x[0])), 1):
            place[x[0]] = n
    assert {r.id: r.place for r in order.ranked_within(df, "k", ["v", "id"], "place").collect()} == place
    before = order.materialise
    kept = []
    order.materialise = lambda t, label: kept.append(before(t, label)) or kept[-1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would become one partition
    try:
        order.ranked_within(df, "k", ["v", "id"], "place")
    finally:
        order.materialise = before
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kept[0].filter("k = 'a'").select(F.countDistinct("part_")).first()[0] > 1


def test_mapping_queries_take_every_read(spark, tmp_path):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    contigs = [(i, word(900)) for i in range(3)]
    ref = dict(contigs)
    back = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    reads = [(1, "q/1", ref[1][50:190], "F" * 140), (2, "q/2", back(ref[1][400:520]), "#" * 120), (3, "alone/1", ref[2][700:830], "F" * 130), (4, "none", word(120), "F" * 120)]
    a, b = ref[0][500:640], ref[0][700:820]
    sam = [(11, "x", 97, "chr1", 10, 210, 320, a, "F" * 140, 1), (12, "y", 145, "chr1", 210, 10, -320, b, "#" * 120, 1), (13, "z", 0, "chr1", 5, 0, 0, a, "F" * 140, 1)]
    d = saved(
        spark, tmp_path, fasta_records=(contigs, "rec_id long, seq string"), fastq_reads=(reads, "read_id long, name string, seq string, qual string"),
        sam_alignments=(sam, "aln_id long, qname string, flag int, rname string, pos long, pnext long, tlen int, seq string, qual string, loaded_at long"),
    )
    q = entry.queries()
    got = {(r.qname, bool(r.flag & 128)): (r.rname, r.pos, r.cigar) for r in q["map_pairs"](spark, d).collect()}
    assert got["f1", False] == ("r000000001", 51, "140M") and got["f1", True] == ("r000000001", 401, "120M")
    assert got["f3", False] == ("r000000002", 701, "130M") and got["f4", False][0] == "*"
    assert got["a11-12", False] == ("r000000000", 501, "140M") and got["a11-12", True] == ("r000000000", 701, "120M")
    small = {(r.qname, r.rname, r.pos) for r in q["map_small_rna"](spark, d).collect()}
    assert {("f1", "r000000001", 51), ("f3", "r000000002", 701)} <= small
    trimmed = {r.name: (r.seq1, r.qual1, r.kept) for r in q["trim_pairs"](spark, d).collect()}
    assert {f"f{i}": (s, x, len(s)) for i, _, s, x in reads}.items() <= trimmed.items() and trimmed["a11-12"][2] == 120
    assert q["call_variants"](spark, d).count() >= 3


def test_small_rna_counts_hits_over_blocks(spark, monkeypatch):
    from strandloom.operators import kernel_ops as ko
    from tests.conftest import rows

    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    back = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    copies = {"six": (6, 6), "many": (11, 2), "two": (1, 1), "five": (5, 3), "swap": (0, 1), "alone": (1, 0)}
    words = {k: word(30) for k in copies}
    chroms = [["", ""][i] + "".join(word(20) + (back(words[k]) if k == "five" and i else words[k]) for k, n in copies.items() for _ in range(n[i])) + word(20) for i in range(2)]
    s = words["swap"]
    chroms[0] += s[:24] + ("A" if s[24] != "A" else "C") + s[25:] + word(20)
    reference = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(chroms)], "name string, seq string")
    reads = spark.createDataFrame([(k, w, "I" * 30) for k, w in words.items()] + [("alone", words["two"], "I" * 30)], "name string, seq string, qual string")
    whole = rows(ko.map_small_rna(reads, reference))
    original, most = ko.reference_blocks, max(map(len, chroms))
    assert len(original(reference, most=most)) == 2
    monkeypatch.setattr(ko, "reference_blocks", lambda r: original(r, most=most))
    parted = rows(ko.map_small_rna(reads, reference))
    assert parted == whole
    n = {k: sum(r[0] == k for r in parted) for k in copies}
    assert n == {"six": 0, "many": 0, "two": 2, "five": 8, "swap": 1, "alone": 3}
    assert {r[-1][0] for r in parted if r[0] == "two"} == {"NH:i:2"}


def test_mates_are_rescued_beside_every_equal_place():
    from strandloom.kernels import aligner

    rng = random.Random(10)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    copy, parts = word(150), [word(2500) for _ in range(60)]
    text = "".join(p + copy for p in parts) + word(900)
    genome = aligner.Genome([("c", text)])
    at = [i * 2650 + 2500 for i in range(60)]
    for k in (3, 7, 45):
        mate = list(text[at[k] + 300 : at[k] + 400])
        for i in range(10, 100, 15):  # no seed of 19 bases is left
            mate[i] = "A" if mate[i] != "A" else "C"
        first, second = aligner.map_pairs(genome, [(("q", copy[:100], "I" * 100), ("q", aligner.revcomp("".join(mate)), "I" * 100))])[0]
        assert first[3] == at[k] + 1 and abs(second[3] - at[k] - 301) <= 10
    assert len(aligner.candidates(genome, [copy[:100]])[0]) == 60


def test_alignment_queries_take_whole_reads(spark, tmp_path):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    reads = [(1, word(140), "F" * 140), (2, word(60), "F" * 60), (3, word(110), "F" * 90), (4, "A", "F")]
    reads.append((5, reads[0][1][:130] + "N" * 10, "F" * 130 + "#" * 10))
    d = saved(spark, tmp_path, fastq_reads=(reads, "read_id long, seq string, qual string"))
    q = entry.queries()
    size = {i: len(s) for i, s, _ in reads}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert {r.read_id: r.score for r in q["align_global_edits"](spark, d).collect()} == {i: -edits(s, s[7:]) for i, s, _ in reads}
    assert {r.read_id for r in q["align_overhang"](spark, d).collect()} == set(size)
    local = {r.read_id: r for r in q["align_local"](spark, d).collect()}
    assert all(local[i].score == size[i] and local[i].end_at - local[i].begin_at == size[i] for i in (1, 2, 3))
    lik = {(r.read, r.haplotype): r.lik for r in q["pairhmm_likelihoods"](spark, d).collect()}
    assert {r for r, _ in lik} == set(size) and len(lik) == 15
    assert all(lik[i, 0] > lik[i, 1] for i in (1, 2, 3)) and lik[1, 0] != lik[5, 0]
