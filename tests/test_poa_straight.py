import random

import pytest

from strandloom.kernels import poa


@pytest.mark.parametrize("score", [(5, -4, -8, None), (5, -4, -8, -2), (0, -1, -1, None), (2, -3, -1, -1)])
def test_alignments_without_gaps_are_those_of_the_matrix(monkeypatch, score):
    """Graphs built with and without the shortcut are the same, also where changes lie side by side."""
    rng = random.Random(41)
    quick = poa.Graph._without_gaps
    used = []
    for _ in range(60):
        base = "".join(rng.choices("ACGT"[: rng.choice([2, 4])], k=rng.randint(1, 40)))
        seqs = [base]
        for _ in range(rng.randint(1, 6)):
            s = list(base)
            for at in rng.sample(range(len(s)), min(len(s), rng.randint(0, 3))):
                s[at] = rng.choice("ACGT")
            if rng.random() < 0.15:
                del s[rng.randrange(len(s))]
            seqs.append("".join(s))
        built = []
        for way in (lambda *a: used.append(bool(x := quick(*a))) or x, lambda *a: []):
            monkeypatch.setattr(poa.Graph, "_without_gaps", way)
            g = poa.build(seqs, *score)
            built.append((g.letter, g.groups, g.weight, g.paths, g.msa(), g.consensus()))
        assert built[0] == built[1]
    assert any(used)


def test_copies_with_a_changed_base_need_no_matrix(monkeypatch):
    rng = random.Random(42)
    read = "".join(rng.choices("ACGT", k=120))
    copies = [read[: k - 1] + read[k - 1].translate(str.maketrans("ACGT", "CGTA")) + read[k:] for k in (30, 60, 90)]
    monkeypatch.setattr(poa.Graph, "_trace", lambda *a: pytest.fail("a matrix was filled"))
    assert poa.build(copies).consensus() == read
