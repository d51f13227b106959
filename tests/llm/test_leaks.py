import random

import numpy as np

from strandloom.llm import leaks
from tests.conftest import rows
from tests.llm.pages import SCHEMA, page


def same(page_word, item_word):
    if page_word == item_word:
        return True
    if sum(c.isalpha() for c in item_word) < 4:
        return False
    return any(c.isalpha() and page_word[:i] == item_word[:i] and page_word[i + n :] == item_word[i + 1 :] and len(page_word) >= i + n for n in (1, 2) for i, c in enumerate(item_word))


def longest(page_words, item_words):
    best = 0
    for a in range(len(page_words)):
        for b in range(len(item_words)):
            n = 0
            while a + n < len(page_words) and b + n < len(item_words) and same(page_words[a + n], item_words[b + n]):
                n += 1
            best = max(best, n)
    return best


def test_read_as_against_definition():
    rng = random.Random(0)
    vocabulary = ["quay", "quays", "cross", "the", "a1bc", "wool", "pool", "lost", "29", "café"]
    items = leaks.prepare([(1, " ".join(vocabulary * 3))])
    names = list(items.words)
    seen = set(vocabulary)
    for w in vocabulary:
        for i in range(len(w)):
            for x in ("v", "ii", "0", "cl", ""):
                seen.add(w[:i] + x + w[i + 1 :])
        seen.add(w + rng.choice("xyz"))
    for t in seen:
        assert {names[i] for i in leaks.read_as(t, items)} == {w for w in vocabulary if same(t, w)}, t


def test_covering():
    rng = np.random.default_rng(1)
    for n in (5, 24, 60):
        keep = set(leaks.covering(rng.integers(0, 5, n), 24).tolist())
        assert all(keep & set(range(a, a + 24)) for a in range(n - 23))


def test_tiles_are_greedy():
    assert leaks.tiles([(5, 0, 0), (9, 3, 3), (4, 20, 12), (4, 20, 1)], 4) == [(9, 3, 3), (4, 20, 12)]
    # the rest of an overlapped match waits again
    assert leaks.tiles([(60, 0, 0), (61, 62, 39)], 12) == [(61, 62, 39), (39, 0, 0)]
    assert leaks.tiles([(60, 0, 0), (61, 62, 39)], 40) == [(61, 62, 39)]
    assert leaks.tiles([], 5) == []


def test_tiles_against_marking_unit_by_unit():
    rng = random.Random(2)
    for _ in range(200):
        page, item = ([rng.choice("ab") for _ in range(n)] for n in (30, 20))
        ms = []
        for a in range(30):
            for b in range(20):
                if a and b and page[a - 1] == item[b - 1]:
                    continue
                n = 0
                while a + n < 30 and b + n < 20 and page[a + n] == item[b + n]:
                    n += 1
                ms.append((n, a, b))
        got = leaks.tiles(ms, 3)
        taken_a, taken_b, lengths = set(), set(), []
        while True:  # greedy string tiling as published
            best = (2, 0, 0)
            for a in range(30):
                for b in range(20):
                    n = 0
                    while a + n < 30 and b + n < 20 and page[a + n] == item[b + n] and a + n not in taken_a and b + n not in taken_b:
                        n += 1
                    best = max(best, (n, -a, -b))
            n, a, b = best[0], -best[1], -best[2]
            if n < 3:
                break
            lengths.append((n, a, b))
            taken_a |= set(range(a, a + n))
            taken_b |= set(range(b, b + n))
        assert got == lengths


def test_moved_passages(spark):
    rng = random.Random(9)
    new = lambda n: ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)]
    item = new(100)
    runs = [item[i : i + 20] for i in range(0, 100, 20)]
    overlapped = item[:60] + new(2) + item[39:]
    moved = [w for r in (3, 1, 4, 0, 2) for w in (*runs[r], *new(30))]
    half = [w for r in (3, 1) for w in (*runs[r], *new(30))]
    apart = [runs[4] + new(20), runs[0] + new(5) + runs[2]]
    lay = lambda *cols: page([[("a", " ".join(c[i : i + 7])) for i in range(0, len(c), 7)] for c in cols])
    pages = [lay(overlapped), lay(moved), lay(half), lay(*apart), lay(item[:12] + new(10))]
    df = spark.createDataFrame([(d, t, b, 0) for d, (t, b) in enumerate(pages)], SCHEMA)
    questions = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.longest, r.coverage, r.in_a_row) for r in leaks.leaked_items(df, "doc_id", "text", "line_boxes", questions, "item_id", "text").collect()}
    assert got == {0: (61, 1.0, True), 1: (20, 1.0, False), 3: (20, 0.6, False)}


def test_extension_by_runs():
    rng = np.random.default_rng(3)
    p, q = rng.integers(0, 2, 400), rng.integers(0, 2, 300)
    q[50:250] = p[100:300]
    a, b = rng.integers(0, 400, 500), rng.integers(0, 300, 500)
    a[:100], b[:100] = np.arange(100, 200), np.arange(50, 150)
    same = lambda x, y: p[x] == q[y]
    for step, ends in ((1, (399, 299)), (-1, (0, 0))):
        got = leaks._extend(same, leaks.run_hashes(p), leaks.run_hashes(q), a, b, *(np.full(500, e) for e in ends), step)
        for x, y, n in zip(a, b, got):
            want = 0
            while 0 <= x + step * (want + 1) < 400 and 0 <= y + step * (want + 1) < 300 and p[x + step * (want + 1)] == q[y + step * (want + 1)]:
                want += 1
            assert n == want


def misread(rng, w):
    if sum(c.isalpha() for c in w) < 4 or rng.random() > 0.3:
        return w
    i = rng.choice([i for i, c in enumerate(w) if c.isalpha()])
    return w[:i] + rng.choice(["x", "ii", "5", "rn"]) + w[i + 1 :]


def test_leaked_items_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["the", "of", "at", "was", "quay", "bridge", "long", "debate", "Pellby", "Wexric", "Torilcombe", "twenty-one", "£29.40,", "Mrs.", "Ott"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 24, 40, 60])))) for i in range(25)] + [(30, None), (31, ""), (32, "short")]
    pages, words_of = [], []
    for _ in range(40):
        cols, words = [], []
        for _ in range(2):
            text = [rng.choice(vocabulary) for _ in range(30)]
            src = rng.choice(items[:25])[1].split()
            a = rng.randint(0, max(0, len(src) - 20))
            text[10:10] = [misread(rng, w) for w in src[a : a + rng.choice([20, 23, 24, 30, 60])]]
            words.append(leaks.tokens(" ".join(text)))
            lines, k = [], 0
            while k < len(text):
                n = rng.randint(2, 6)
                line = " ".join(text[k : k + n])
                k += n
                if k < len(text) and rng.random() < 0.3 and len(text[k]) > 4 and text[k].isalpha():
                    line += " " + text[k][:3] + rng.choice("-‐¬")
                    text[k] = text[k][3:]
                lines.append(("a", line.upper() if rng.random() < 0.1 else line))
                if rng.random() < 0.1 and not line.endswith(("-", "‐", "¬")):
                    lines.append(("d", "soap at Ulley!"))
            cols.append(lines)
        pages.append(page(cols, rng.random() < 0.5))
        words_of.append(words)
    want = set()
    for d, cols in enumerate(words_of):
        for i, t in items:
            if t and max(longest(c, leaks.tokens(t)) for c in cols) >= 24:
                want.add((d, i))
    df = spark.createDataFrame([(d, t, b, 0) for d, (t, b) in enumerate(pages)] + [(99, None, None, 0), (98, "", [], 0)], SCHEMA)
    questions = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.leaked_items(df.union(df), "doc_id", "text", "line_boxes", questions, "item_id", "text")
    found = {(r.doc_id, r.item_id) for r in got.filter("in_a_row").collect()}
    assert found == want and want
    assert all((r.longest >= 24) == r.in_a_row and 0 < r.coverage <= 1 and (r.in_a_row or r.coverage >= 0.5) for r in got.collect())
    assert rows(leaks.leaked_items(df.limit(0), "doc_id", "text", "line_boxes", questions, "item_id", "text")) == []
    assert rows(leaks.leaked_items(df, "doc_id", "text", "line_boxes", questions.limit(0), "item_id", "text")) == []


def test_characters(spark, monkeypatch):
    item = "樫原朔江氏は校務会に、鶴砂崎村近くの荒れた渡し場が10日までに売却されると述べた。町議会は皆の予想に反し、月松崎町の灯台を任せると決めた。"
    plain = leaks.characters(item)
    lines = lambda x: [("a", x[i : i + 9]) for i in range(0, len(x), 9)]
    pages = [page([lines("黒い橋を去った。" + item[5:60]), lines("白")]), page([lines(plain[3:46])]), page([lines("黒" + plain[3:47])]), page([lines(item[:25] + "黒" + item[25:])])]
    df = spark.createDataFrame([(d, t, b, 0) for d, (t, b) in enumerate(pages)], SCHEMA)
    questions = spark.createDataFrame([("q1", item), ("q2", "英語 " + "短い")], "item_id string, text string")
    monkeypatch.setattr(leaks, "BLOCK_CHARACTERS", 10)  # a block for each item
    got = rows(leaks.leaked_items(df, "doc_id", "text", "line_boxes", questions, "item_id", "text").filter("in_a_row").select("doc_id", "item_id", "longest"))
    rest = len(plain) - len(leaks.characters(item[:25]))
    want = [(0, "q1", len(leaks.characters(item[5:60]))), (2, "q1", 44)] + ([(3, "q1", rest)] if rest >= 44 else [])
    assert got == sorted(want, key=str)
