import itertools
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import layout, sentences
from tests.llm.pages import SCHEMA, page

TEXTS = [
    ["The coach for Kessidane left at 10.40 a.m. and reached Ulley at 8.49 p.m.", "Dr. Maroham, of No. 18 St. Pell Street, came.", "Why was it sold?", "The board gave no answer...", "“The flax is lost!” cried Mrs. Pellton after a long debate.", "They met... and yet nothing was named.", "29 casks of wool for Calis, i.e. about £29.40, were taken by Lieut. Varer.", '"We keep it," said Capt. Ott, "and the office will pay for the coal."', "“It is Telric's coal!”", "The crowd left."],
    ["Nach Pellaric fuhr er um 9.06 Uhr, ca. 14,5 Stunden später.", "Der Preis stieg am 3. Oktober auf 4,22 Mark.", "„Wird die Scheune einstürzen?“, fragte Fr. Varoby.", "„Das ist Hapmark!“", "Die Menge verließ den Platz."],
    ["« C'est Dunbeck ! »", "La foule quitta la halle.", "« Nous garderons la tour, » dit Ulmark, « et la guilde paiera. »", "M. Dunilric a payé 5,14 p. cent de plus, etc., à 5 h. 48."],
    ["«¡Es Nithilton!»", "La gente dejó la lonja.", "«Guardaremos la torre», dijo el Dr. Ostorton, «y pagará la junta».", "¿Por qué dejó Varton la presa?"],
    ["“青旻湾村的桥会出售吗？”秦澄舟问港务会的代表沈乔岚。", "租金25.18元。", "村民离开了渡口……直到8日才有消息。"],
    ["「橋は売却されるのか。」と樫原が尋ねた。", "木材は20.34円に上がった。"],
    ["डॉ. सोमावन ने कहा कि बाज़ार बंद होगा।", "“क्या बाज़ार फिर बनेगा?” वेदावन ने नगर परिषद से पूछा।"],
]


NAMES = re.compile("Kessidane|Ulley|Maroham|Pellton|Pellaric|Pell|Calis|Varer|Varoby|Varton|Ott|Telric|Hapmark|Dunbeck|Ulmark|Dunilric|Nithilton|Ostorton")


@cache
def fitted():
    """Fitted on the texts' sentences in many orders with other names, so that names are many and words recur."""
    rng = random.Random(0)
    name = lambda m: "".join(rng.choice(["bel", "dor", "kim", "ru", "stan", "ley", "mar"]) for _ in range(3)).title()
    streams = []
    for _ in range(80):
        for t in TEXTS:
            units = [NAMES.sub(name, u) for u in rng.sample(t, len(t))]
            streams.append(" ".join(units) if t[0].isascii() or t[0][0] in "N„«“«" else "".join(units))
    return sentences.fit(streams)


@pytest.mark.parametrize("units", TEXTS)
def test_streams(units):
    glue = "" if units[0][0] in "“「" and ord(units[0][1]) > 0x3000 else " "
    x = glue.join(units)
    model = fitted()
    want, at = [], 0
    for u in units:
        at += len(u)
        want.append(at - 1)
        at += len(glue)
    got = [c.at for c in sentences.candidates(x) if model.emission(c) > 0]
    assert got == want


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    model = sentences.Model(near=-1.5, near_length=4)
    score, at, seq = [], [], []
    for s in range(40):
        n = int(rng.integers(1, 8))
        score += rng.normal(size=n).tolist()
        at += np.cumsum(rng.integers(1, 9, n)).tolist()
        seq += [s] * n
    score, at, seq = np.array(score), np.array(at), np.array(seq)
    tags = sentences.viterbi(score, at, seq, model)

    def value(t, idx):
        v = sum(score[i] for i, x in zip(idx, t) if x)
        return v + sum(model.near for (i, x), (j, y) in zip(zip(idx, t), list(zip(idx, t))[1:]) if x and y and at[j] - at[i] <= 4)

    for s in range(40):
        idx = np.flatnonzero(seq == s)
        best = max(value(t, idx) for t in itertools.product([False, True], repeat=len(idx)))
        assert abs(value(tags[idx], idx) - best) < 1e-9
    assert sentences.viterbi(np.empty(0), np.empty(0), np.empty(0), model).tolist() == []


def rows_of(spark, pages):
    return spark.createDataFrame([(i, t, b, 1) for i, (t, b) in enumerate(pages)], SCHEMA)


def read(spark, pages, model):
    df = rows_of(spark, pages)
    got = sentences.sentences(df, "doc_id", "text", "line_boxes", model).collect()
    ends = {(r.doc_id, r.end_at) for r in sentences.sentence_ends(df, "doc_id", "text", "line_boxes", model).collect()}
    assert ends == {(r.doc_id, r.end_at) for r in got}
    out = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.sentence_no)):
        out.setdefault(r.doc_id, []).append(r.sentence)
    return out, ends


def test_pages(spark):
    left = [("h", "COAL"), ("h", "DEARER"), ("a", "left the old quay. The cro-"), ("a", "wd met without"), ("d", "Soap! Only 5s. a"), ("d", "box at Ulley"), ("a", "delay. Nobody knew")]
    right = [("a", "why. On Oct. 29 the ship"), ("a", "came. A coach left at")]
    model = fitted()
    pages = [page([left, right]), page([left, right], interleaved=True)]
    out, ends = read(spark, pages, model)
    want = ["COAL DEARER", "left the old quay.", "The crowd met without delay.", "Nobody knew", "Soap!", "Only 5s. a box at Ulley", "why.", "On Oct. 29 the ship came.", "A coach left at"]
    assert sorted(out[0]) == sorted(want) == sorted(out[1])
    for i, (text, _) in enumerate(pages):
        assert all(text[a] in ".!" or text[a + 1 : a + 2] in ("\n", "") for d, a in ends if d == i)


def test_thai_blanks(spark):
    lines = [("a", "ราคาปอที่คลองตาลขึ้นถึง 29.32 บาท "), ("a", "นายปรชาติบอกสมาคม วันที่ 27 นี้"), ("a", "สมพรขาย")]
    out, _ = read(spark, [page([lines])], fitted())
    assert out[0] == ["ราคาปอที่คลองตาลขึ้นถึง 29.32 บาท", "นายปรชาติบอกสมาคม", "วันที่ 27 นี้สมพรขาย"]


def test_odd_rows(spark):
    model = fitted()
    long = "He came. " * 30_000
    pages = [(None, None), ("", []), ("  \n ", None), ("One. Two", None), ("A b. C d.\nE", [(1, 2, 3, 4, 0.5)]), (long, None), ("One. Two", None)]
    out, ends = read(spark, pages, model)
    assert set(out) == {3, 4, 5, 6} and out[3] == out[6] == ["One.", "Two"]
    assert len(out[5]) == 30_000
    assert sentences.sentence_ends(rows_of(spark, pages).limit(0), "doc_id", "text", "line_boxes", model).count() == 0
    assert sentences.fit(iter([])).weights == {}
    # without weights only streams end
    bare, _ = read(spark, pages, sentences.Model())
    assert {k: len(v) for k, v in bare.items()} == {3: 1, 4: 1, 5: 1, 6: 1}
    assert isinstance(sentences.fit_on(rows_of(spark, pages), "doc_id", "text", "line_boxes", 3), sentences.Model)


def test_layout_keeps_every_line_once():
    rng = random.Random(0)
    texts, boxes = [], []
    for _ in range(30):
        cols = [[(rng.choice("aaaadh"), f"line {rng.random()}") for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 3))]
        t, b = page(cols, rng.random() < 0.5)
        texts.append(t)
        boxes.append(b if rng.random() < 0.9 else None)
    arrays = [pa.array([None if b is None else [x[i] for x in b] for b in boxes], pa.list_(pa.int32())) for i in range(4)]
    whole = layout.read(texts, *arrays)
    sliced = layout.read(texts[7:19], *(a.slice(7, 12) for a in arrays))
    assert sliced.lines == [x for x, n in zip(whole.lines, whole.stream) if 7 <= whole.doc[n] < 19]
    s = whole
    seen = {}
    for line, o, n in zip(s.lines, s.offset, s.stream):
        d = int(s.doc[n])
        assert texts[d][o : o + len(line)] == line
        seen.setdefault(d, []).append(line)
    assert all(sorted(seen.get(i, [])) == sorted(t.split("\n") if t else []) for i, t in enumerate(texts))


def test_words_are_learned_without_lists(monkeypatch):
    """An invented title is told from an invented noun by what follows and where else words stand."""
    monkeypatch.setattr(sentences, "GOES_ON", frozenset())
    monkeypatch.setattr(sentences, "MAY_END", frozenset())
    rng = random.Random(4)
    name = lambda: "".join(rng.choice(["bel", "dor", "kim", "ru", "stan"]) for _ in range(3)).title()
    verbs, nouns = ["sold", "found", "lost", "kept"], ["wool", "quay", "mill", "coal", "barn"]
    texts = []
    for _ in range(400):
        a = f"The {rng.choice(nouns)} was {rng.choice(verbs)} by Brg. {name()} near the {rng.choice(nouns)}."
        b = f"Has {name()} {rng.choice(verbs)} the {rng.choice(nouns)}?" if rng.random() < 0.5 else f"A {rng.choice(nouns)} at {name()} burned!"
        c = f"It cost {rng.randint(2, 90)}.{rng.randint(10, 99)} qf. and was {rng.choice(verbs)} by the {rng.choice(nouns)}."
        texts.append(" ".join(rng.sample([a, b, c], 3)))
    model = sentences.fit(iter(texts[:300]))
    assert model.lexicon.of_word["brg"] == "on" and model.lexicon.of_word["quay"] == "ends"
    for x in texts[300:]:
        got = {c.at for c in sentences.candidates(x) if model.emission(c) > 0}
        want = {i for i, ch in enumerate(x) if ch in "?!" or (ch == "." and x[i - 3 : i] not in ("Brg", " qf") and not x[i + 1 : i + 2].isdigit())}
        assert got | {len(x) - 1} == want


def test_blanks_are_learned_from_text_without_punctuation():
    """Thai text has no part in the sample."""
    model = sentences.fit(x for t in TEXTS[4:6] for x in ["".join(t)] * 5)
    x = "สมพรขายผ้า ราคา 25 บาท นายกไปตลาด"
    got = [c.at for c in sentences.candidates(x) if model.emission(c) > 0]
    assert got == [i - 1 for i, c in enumerate(x) if c == " " and not (x[i - 1].isdigit() or x[i + 1].isdigit())]


def test_fitted_on_all_pages(spark):
    """A word that only a few of many pages show is learned, and the model is that of all streams together."""
    rng = random.Random(5)
    name = lambda: "".join(rng.choice(["bel", "dor", "kim", "ru", "stan", "ley"]) for _ in range(3)).title()
    nouns = ["wool", "quay", "mill", "coal", "barn"]
    texts = []
    for i in range(1500):
        kinds = [f"The {rng.choice(nouns)} was sold by {'Qvx' if i % 150 == 7 else 'Brg'}. {name()} near the {rng.choice(nouns)}.", f"Has {name()} kept the {rng.choice(nouns)}?!", f"On {rng.randint(1, 28)}. Oktober the {rng.choice(nouns)} “burned!” at 4.{i % 60} Uhr... and no. {i} too."]
        texts.append(" ".join(rng.sample(kinds, 3)))
    texts += ["".join(t) for t in TEXTS[4:]] + ["The barn of Yarrop burned. The wool is sold at Yarrop. 64 casks of coal are lost."] * 40
    df = rows_of(spark, [(t, None) for t in texts]).repartition(3)
    model = sentences.fit_on(df, "doc_id", "text", "line_boxes")
    # a copied phrase doesn't make an abbreviation of its word, as many numbers do
    assert model.lexicon.of_word["qvx"] == "on" and model.lexicon.of_word["no"] == "on" and "yarrop" not in model.lexicon.of_word
    one = sentences.fit(iter(texts))
    assert model.lexicon.of_word == one.lexicon.of_word and model.lexicon.dates == one.lexicon.dates and model.lexicon.small <= one.lexicon.small
    assert (model.weights, model.bias, model.near) == (one.weights, one.bias, one.near)
    # the written candidates are decoded as those of the texts
    pages = sentences.read_pages(df, "doc_id", "text", "line_boxes")
    got = sorted(map(tuple, sentences.page_ends(pages, model).collect()))
    assert got == sorted(map(tuple, sentences.sentence_ends(df, "doc_id", "text", "line_boxes", model).collect()))
