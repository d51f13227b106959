import random

import numpy as np
import pytest

from strandloom.kernels import alignment as al
from strandloom.kernels import fmindex, pairhmm, poa, suffix

REF = "AATCGAAGGTCGTAAGGACACGGTTGAGCGTTCAGCGTTCATGTGAGTCCTCACCACTTATGGCTCCATAGCCTGCTATTTAAGTGGGTTACCGGTCTCCGCCAAGTAGCTGGTGTAAGAACACAGTAACTGAGCCCAGTGTGATCAGCCCTAACGAGGTAC"


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("k", [None, 1, 3, 8, 256])
def test_suffix_array(k):
    rng = random.Random(1)
    for n in (0, 1, 2, 40, 300):
        s = dna(rng, n, "AC")
        want = sorted(range(n + 1), key=lambda i: s[i:] if k is None else s[i : i + k])
        if k is None or n == 0:
            assert suffix.suffix_array(s, k).tolist() == want
        else:
            got = suffix.suffix_array(s, k).tolist()
            assert [s[i : i + k] for i in got] == [s[i : i + k] for i in want] and got == want


def test_overhang_goldens():
    a, b = list(REF), list(REF)
    for i in range(70, 80):
        a[i], b[i] = "A", "T"
    got = al.align(["".join(a), REF, REF, REF], ["".join(b), REF[:70] + REF[71:], REF[:70] + "T" + REF[70:], REF])
    assert [(x.begin, x.cigar) for x in got] == [(0, "69M10D1M10I82M"), (0, "70M1D91M"), (0, "70M1I92M"), (0, "162M")]


def plain_scores(r, q, s, mode):
    n, m = len(r), len(q)
    H = [[0] * (m + 1) for _ in range(n + 1)]
    if mode == "global":
        for i in range(1, n + 1):
            H[i][0] = s.gap_open + s.gap_extend * (i - 1)
        for j in range(1, m + 1):
            H[0][j] = s.gap_open + s.gap_extend * (j - 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            v = H[i - 1][j - 1] + (s.match if r[i - 1] == q[j - 1] else s.mismatch)
            v = max(v, max(H[i - k][j] + s.gap_open + s.gap_extend * (k - 1) for k in range(1, i + 1)))
            v = max(v, max(H[i][j - k] + s.gap_open + s.gap_extend * (k - 1) for k in range(1, j + 1)))
            H[i][j] = max(0, v) if mode == "local" else v
    if mode == "global":
        return H[n][m]
    if mode == "local":
        return max(max(x) for x in H)
    return max(max(H[i][m] for i in range(1, n + 1)), max(H[n][1:]))


def cost(r, q, a, s):
    """Score of an alignment's own steps."""
    import re

    i, j, total = a.begin, 0, 0
    for n, op in re.findall(r"(\d+)([MIDS])", a.cigar):
        n = int(n)
        if op == "M":
            total += sum(s.match if r[i + k] == q[j + k] else s.mismatch for k in range(n))
            i, j = i + n, j + n
        elif op == "S":
            j += n
        else:
            total += s.gap_open + s.gap_extend * (n - 1)
            i, j = (i + n, j) if op == "D" else (i, j + n)
    assert i == a.end and j == len(q)
    return total


@pytest.mark.parametrize("mode", ["overhang", "local", "global"])
def test_alignment_against_plain_recurrence(mode):
    rng = random.Random(2)
    refs = [dna(rng, rng.randint(1, 30)) for _ in range(60)]
    reads = [dna(rng, rng.randint(1, 25)) if rng.random() < 0.4 else r[rng.randint(0, 3) :] + dna(rng, 2) for r in refs]
    for s in (al.STRIPED, al.NEW_DEFAULT, al.ORIGINAL):
        s = al.Scoring(s.match, s.mismatch, s.gap_open, s.gap_extend)
        for r, q, a in zip(refs, reads, al.align(refs, reads, s, mode, shortcut=False)):
            assert a.score == plain_scores(r, q, s, mode)
            assert cost(r, q, a, s) == a.score
    assert al.align(["", "AC"], ["AC", ""], mode=mode)[0].score <= 0


def test_pairhmm():
    subject = "AC" * 40
    rng = random.Random(3)
    haps = [dna(rng, 60), dna(rng, 45), dna(rng, 52)]
    haps.append(haps[0][:20] + haps[0][22:])
    reads = [(haps[0][10:40], pairhmm.error_rates("I" * 30)), (dna(rng, 12), pairhmm.error_rates("5" * 12))]

    def plain(seq, err, hap):
        n, m = len(seq), len(hap)
        M, I, D = (np.zeros((n + 1, m + 1)) for _ in range(3))
        D[0] = pairhmm.INITIAL / m
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                prior = 1 - err[i - 1] if seq[i - 1] == hap[j - 1] else err[i - 1] / 3
                M[i, j] = prior * (M[i - 1, j - 1] * 0.9998 + (I[i - 1, j - 1] + D[i - 1, j - 1]) * 0.9)
                I[i, j] = M[i - 1, j] * 0.0001 + I[i - 1, j] * 0.1
                D[i, j] = M[i, j - 1] * 0.0001 + D[i, j - 1] * 0.1
        return np.log10((M[n, 1:] + I[n, 1:]).sum()) - np.log10(pairhmm.INITIAL)

    got = pairhmm.log10_likelihoods(reads, haps)
    for r, (seq, err) in enumerate(reads):
        for h, hap in enumerate(haps):
            assert abs(got[r, h] - plain(seq, err, hap)) < 1e-9
    assert got[0].argmax() in (0, 3) and pairhmm.capped(got).min() >= pairhmm.capped(got).max(axis=1).min() - 4.5
    assert pairhmm.well_modelled(np.array([[-1.0], [-30.0]]), [100, 100]).tolist() == [True, False]
    assert pairhmm.well_modelled(np.array([[-1.0]]), [100], True).tolist() == [False]
    assert pairhmm.log10_likelihoods([], [subject]).shape == (0, 1)


@pytest.mark.parametrize("seqs, score, want", [
    (["CTTTTC", "CTATATATC"], (5, -6, -10), ["CT-T-T-TC", "CTATATATC"]),
    (["ATCCTGG", "ATCGCTG"], (5, -1, -10), ["ATCCTGG", "ATCGCTG"]),
    (["ATCCTGG", "ATCGCTG"], (5, -10, -1), ["ATC-CTGG", "ATCGCT-G"]),
])
def test_poa_goldens(seqs, score, want):
    assert [r.replace("-", "") for r in poa.build(seqs, *score).msa()] == seqs
    got = poa.build(seqs, *score).msa()
    assert len(got[0]) == len(want[0])
    assert sum(a == b != "-" for a, b in zip(*got)) == sum(a == b != "-" for a, b in zip(*want))


def test_poa_invariants():
    rng = random.Random(5)
    for local in (False, True):
        for extend in (None, -1):
            base = dna(rng, 40)
            seqs = [base] + ["".join(c for c in base if rng.random() > 0.1) for _ in range(5)] + [""]
            g = poa.build(seqs, 5, -4, -6, extend, local)
            rows = g.msa(with_consensus=True)
            assert [r.replace("-", "") for r in rows[:-1]] == seqs[:-1] and len({len(r) for r in rows}) == 1
            assert rows[-1].replace("-", "") == g.consensus() and len(g.coverage()) == len(g.consensus())
    majority = poa.build(["ACGTACGTAC"] * 3 + ["ACGAACGTAC"], 5, -4, -8)
    assert majority.consensus() == "ACGTACGTAC" and majority.consensus(4) == "ACGACGTAC"
    assert poa.Graph().consensus() == "" and poa.build([]).msa() == [] and "n0 -> n1" in majority.dot()
    assert "".join(majority.subgraph(1, 3).letter).startswith("CG")
    with pytest.raises(ValueError):
        majority.align("A", gap=1)


def test_poa_by_edits():
    g = poa.build_by_edits(["ACTG", "ACTCG", "ATCGG"])
    rows = g.msa()
    assert [r.replace("-", "") for r in rows] == ["ACTG", "ACTCG", "ATCGG"] and len(g.consensus()) in (4, 5, 6)


@pytest.mark.parametrize("sampling", [1, 3, 4])
def test_fm_index(sampling):
    rng = random.Random(6)
    text = dna(rng, 700, "ACG") + "TTTT" + dna(rng, 300)
    index = fmindex.FMIndex(text, sampling, block=16)
    words = [text[i : i + n] for i in range(0, 990, 83) for n in (1, 2, 5, 12, 40)] + ["TTTTTTTTTT", "", "ACGTTTACGACC"]
    for w in words:
        want = [i for i in range(len(text) + 1 - len(w)) if text[i : i + len(w)] == w] if w else list(range(len(text) + 1))
        assert index.find(w).tolist() == want
    lo, hi = index.ranges([fmindex.encode(w) for w in words])
    assert [h - l for l, h in zip(lo, hi)] == [len(index.find(w)) for w in words]
    lo, hi, left = index.range_of(text[100:150], stop=3)
    assert hi - lo <= 3 or left == 0
    assert text[100 + left : 150] in text and len(index.offsets(lo, hi)) == hi - lo


def test_tails():
    from strandloom.kernels import tails as tl

    rng = random.Random(8)
    chroms = [("c1", dna(rng, 800)), ("c2", dna(rng, 500))]
    genome = tl.Genome(chroms)
    text = dict(chroms)
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    other = lambda c: "ACGT"[("ACGT".index(c) + 1) % 4]

    def run(seq, **o):
        return tl.map_reads(genome, [("r", seq, "I" * len(seq))], tl.Options(**o))[0]

    for name, at in (("c1", 100), ("c2", 7), ("c1", 775)):
        w = text[name][at : at + 25]
        f, r = run(w)
        assert [(h.chrom, h.begin, h.end) for h in f.hits] == [(name, at, at + 25)] and not r.hits and f.tail == -1
        f, r = run(rc(w))
        assert [(h.chrom, h.begin, h.end) for h in r.hits] == [(name, at, at + 25)] and not f.hits
        after = text[name][at + 25 : at + 26] or "A"
        tailed = w + other(after) + other(text[name][at + 26 : at + 27] or "A") + "CAC"
        f, _ = run(tailed)
        if f.tail >= 0:
            assert f.tail == 25 and [(h.begin, h.end) for h in f.hits] == [(at, at + 25)]
            row = tl.sam_rows(f)[0]
            assert row[3] == at + 1 and row[4] == 255 - 5 and row[5] == "25M5S" and f"TL:Z:{tailed[25:]}" in row[11]
    w = text["c1"][200:226]
    miss = w[:22] + other(w[22]) + w[23:]
    f, _ = run(miss)
    assert f.tail == -1 and f.hits[0].mismatches == [(22, w[22])] and "MD:Z:22" + w[22] + "3" in tl.sam_rows(f)[0][11]
    _, r = run(rc(w)[:22] + other(rc(w)[22]) + rc(w)[23:])
    row = tl.sam_rows(r)[0]
    assert row[1] == 16 and "MD:Z:3" + w[3] + "22" in row[11] and row[9][3] != w[3]
    early = w[:5] + other(w[5]) + w[6:]
    assert not any(m.hits for m in run(early)) and run(early, seed_mismatch=True)[0].hits[0].mismatches == [(5, w[5])]
    k = next(i for i in range(300, 400) if text["c1"][i + 4] == "T")
    edited = text["c1"][k : k + 4] + "C" + text["c1"][k + 5 : k + 25]
    assert not any(m.hits for m in run(edited)) and run(edited, c_to_t=True)[0].hits[0].edits == [4]
    ext = dna(rng, 3) + text["c2"][300:330]
    f, _ = run(ext, adapter5=8)
    assert f.hits[0].end == 330 and 300 - 3 <= f.hits[0].begin <= 300 and f.head == 3 - (300 - f.hits[0].begin)
    assert not any(m.hits for m in run("ACGT")) and not any(m.hits for m in run(w[:20] + "N"))
    repeat = tl.Genome([("r", (dna(rng, 30)) * 12)])
    assert not any(m.hits for m in tl.map_reads(repeat, [("r", "".join("ACGT"[c] for c in repeat.text[:25]), "I" * 25)])[0])


def test_assembly_and_calling():
    from strandloom.kernels import assembly, genotyping

    rng = random.Random(9)
    ref = dna(rng, 300)
    alt = ref[:140] + ("A" if ref[140] != "A" else "C") + ref[141:170] + ref[175:]
    reads = [(h[i : i + 100], "I" * 100) for h in (ref, alt) for i in range(0, len(h) - 99, 8)]
    found = assembly.assemble_haplotypes(reads, ref)
    assert {ref, alt} <= {h.seq for h in found} and found[0].score >= found[-1].score
    lik = pairhmm.capped(pairhmm.log10_likelihoods([(s, pairhmm.error_rates(q)) for s, q in reads], [h.seq for h in found]))
    spans = [(1000 + i, 1000 + i + 100) for h in (ref, alt) for i in range(0, len(h) - 99, 8)]
    calls = genotyping.call_region(found, spans, lik, ref, 1000, 1000, 1300)
    snp = next(c for c in calls if c.begin == 1140)
    assert snp.alleles == [ref[140], alt[140]] and snp.genotype == (0, 1) and snp.gq > 0 and snp.qual >= 30
    assert any(len(c.alleles[0]) == 6 and len(c.alleles[1]) == 1 for c in calls)
    none = genotyping.call_region(assembly.assemble_haplotypes(reads[:26], ref), spans[:26], lik[:26], ref, 1000, 1000, 1300)
    assert none == []
    assert assembly.assemble_haplotypes([], "ACGT") == [] and assembly.assemble_haplotypes([], ref)[0].seq == ref


def test_genotyping_parts():
    from strandloom.kernels import genotyping as gt

    lik = np.log10(np.array([[0.9, 0.1], [0.8, 0.2]]))
    want = [np.log10([0.9 * 0.8]).item(), np.log10([0.5 * 0.5]).item(), np.log10([0.1 * 0.2]).item()]
    assert np.allclose(gt.genotype_likelihoods(lik), want)
    none, counts, absent = gt.allele_frequencies([-20.0, 0.0, -20.0], ["A", "C"])
    assert none < -3 and abs(counts[1] - 1) < 0.2 and absent[1] == none
    assert gt.call(np.array([0.0, -3.0, -9.0]), ["A", "C"], 1, 2) is None
    assert gt.non_reference_posterior((0.0, -5, -9)) == 0 and gt.non_reference_posterior((-30.0, 0.0, -30.0)) > 0.99
    assert gt.reference_confidence("AAAA", [30] * 4, "A")[0] > gt.reference_confidence("CCCC", [30] * 4, "A")[0]
    assert abs(gt._digamma(1.0) + 0.5772156649) < 1e-8


def test_trimming():
    from strandloom.kernels import assembly
    from strandloom.kernels import trimming as tr

    rng = random.Random(10)
    a, b = tr.ADAPTERS
    pairs, inserts = [], []
    for _ in range(120):
        insert = dna(rng, rng.randint(40, 140))
        inserts.append(min(len(insert), 100))
        pairs.append(((insert + a + dna(rng, 80))[:100], (tr.revcomp(insert) + b + dna(rng, 80))[:100]))
    got = tr.detect(pairs)
    n = len(got[0])
    assert n >= 15 and got == (a[:n], b[:n])
    ends = [tr.trim_pair((f, "I" * 100), (r, "I" * 100), got)[2] for f, r in pairs]
    assert sum(abs(x - y) <= 0 for x, y in zip(ends, inserts)) >= 110
    assert tr.detect([])[0] == a and tr.trim_pair(("", ""), ("", ""), got)[2] == 0
    head = tr.trim_pair((dna(rng, 5) + a, "I" * 39), (dna(rng, 5) + b, "I" * 39), (a, b))
    assert head[2] == 5 and tr.trim_pair((dna(rng, 5) + a, "I" * 39), (dna(rng, 5) + b, "I" * 39), (a, b), tr.Options(least_read=10))[2] == 0
    with pytest.raises(ValueError):
        tr.Options(tail_match=2)
    body = dna(rng, 30)
    assert tr.single_end(body + a, a) == 30 and tr.single_end(body + a[:8], a) == 30 and tr.single_end(body + a[:10] + "G" + a[11:], a) == 30
    assert tr.single_end("", a) == 0 and assembly.assemble_adapter([]) == "" and assembly.low_complexity("AAAAAAAC")


def test_aligner():
    from strandloom.kernels import aligner

    rng = random.Random(12)
    genome = aligner.Genome([("c1", dna(rng, 6000)), ("c2", dna(rng, 4000))])
    text = {"c1": genome.seq[:6000], "c2": genome.seq[6000:]}
    pairs, want = [], []
    for n in range(40):
        c = rng.choice(["c1", "c2"])
        at, insert = rng.randint(0, len(text[c]) - 700), rng.randint(300, 650)
        piece = text[c][at : at + insert]
        f, r = piece[:100], aligner.revcomp(piece[-100:])
        if n % 3 == 0:
            f = f[:50] + ("A" if f[50] != "A" else "C") + f[51:]
        if n % 4 == 0:
            f = f[:60] + f[62:]
        if n % 5 == 0:
            f, r = r, f
        pairs.append(((f"q{n}", f, "I" * len(f)), (f"q{n}", r, "I" * len(r))))
        want.append((c, at, at + insert - 100, n % 5 == 0))
    pairs.append((("u", dna(rng, 100), "I" * 100), ("u", "N" * 100, "I" * 100)))
    rows = aligner.map_pairs(genome, pairs)
    for (a, b), (c, lo, hi, turned) in zip(rows, want):
        first, second = (b, a) if turned else (a, b)
        assert first[2] == second[2] == c and first[3] == lo + 1 and abs(second[3] - hi - 1) <= 2
        assert first[1] & 0x2 and second[1] & 0x10 and not first[1] & 0x10 and first[4] >= 20
        assert first[8] == -second[8] > 0 and first[6] == "="
    u = rows[-1]
    assert u[0][1] & 0x4 and u[1][1] & 0x4 and u[0][5] == "*" and u[0][4] == 0
    assert rows[4][0][5] in ("60M2D38M",) or "2D" in rows[4][0][5]
