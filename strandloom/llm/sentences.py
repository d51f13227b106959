"""Sentences of scanned pages in many scripts, by a linear-chain model and Viterbi decoding.

Every character of a stream (see ``layout``) is tagged boundary or inside. Characters that cannot
end a sentence are inside with certainty, so the chain is decoded over the others: runs of
terminators with their closing quotes, and blanks where a script has no terminators. The emission
scores are log-linear in the characters and words around a candidate, the transition scores depend
on the previous tag and the distance to it. The end of a stream is always a boundary. Nothing but
the model decides: without weights no other candidate is a boundary.

The model is fitted here, on all pages of the table, from what their own orthography shows:

* a mark before a small letter or a comma, within a number or within an open quotation ends nothing;
  a question mark, an exclamation mark or a script's own full stop outside of quotations does;
* after a full stop, capital words are compared with those behind question and exclamation marks.
  Words that are written small elsewhere begin sentences, so a word before a full stop ("St.") that
  none of them follows goes on, one that they follow as often as a question mark may end, and one
  that also stands before small letters may do both;
* other full stops have no tag to learn from; the fitted model settles them.

Fixed lists of abbreviations and of words of speech are features among others. For scripts without
punctuation the same tags are learned from the other texts with their punctuation taken out: each
mark becomes a blank that is known by its neighbours only.

Pages are read once: each task writes the candidates of its pages and the counts of their words and
candidates. The lexicon is made of the summed counts, the model fitted on the counts of the candidates'
features and tags, and the written candidates are decoded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import layout
from strandloom.storage import materialise

#: Distinct tokens and candidates that a task counts before it passes the counts on, and candidates whose scores it keeps.
COUNTED = 300_000

# Common abbreviations after which a sentence goes on.
GOES_ON = frozenset(
    "mr mrs ms messrs dr prof hon capt lieut gen col rev st no vol p pp cf viz i.e e.g fig sec art chap "
    "jan feb mar apr jun jul aug sept sep oct nov dec janv févr avr juill déc "
    "z.b d.h vgl nr fr hr s ca bzw u.a m mm mme mlle me sr sra sres d dña núm aprox ud uds p.ej ex cent h r".split()
)
# Abbreviations that may also end a sentence.
MAY_END = frozenset("co cie cía p.m a.m p.m. etc usw jr sen inc ltd".split())
# Words that name a speaker's act in scripts without letter case.
SPEECH = re.compile("问|說|说|道|喊|答|叫|曰|ने [^।?!]{0,80}(?:पूछा|कहा|बताया|पुकारा)")

SIGNS = "-‐‑¬⸗­"
_BROKEN = re.compile(f"[{SIGNS}]\n")
_MARK = re.compile(r"([.!?…。！？।]+)((?:\s?»|[”\"’'\)\]」』›“])*)")
_BLANK = re.compile(r"[  　]+")
_OPEN = "“«‘„「『"
_CLOSING = frozenset('”»“」』"')
_THAI = re.compile("[฀-๿]")
_NORMAL = re.compile(r"\S")
_WORD = re.compile(r"(?<![\w'’])[^\W\d_]+(?![\w])")
_NEXT_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_VOWEL = re.compile("[aeiouyäöüáéíóúâêèà]")
_TAIL = ",;:!?»”’)\"'…"
_LEAD = "(“\"„«‘¡¿'"


def _quote_depths(x: str, marks: list[int]) -> list[bool]:
    """For each place whether it stands inside a quotation that is closed later."""
    spans, start, opened = [], None, ""
    for m in re.finditer('[“”«»„「」『』"]', x):
        c, i = m[0], m.start()
        if start is not None and (c in {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", '"': '"'}[opened]):
            spans.append((start, i))
            start = None
        elif c in "“«„「『" or (c == '"' and (i == 0 or x[i - 1].isspace())):
            # a new opening mark replaces one that was never closed
            start, opened = i, c
    out, k = [], 0
    for p in marks:
        while k < len(spans) and spans[k][1] < p:
            k += 1
        out.append(k < len(spans) and spans[k][0] < p <= spans[k][1])
    return out


def _last_word(x: str, i: int) -> str:
    """The word that ends at i, put together if broken."""
    y = x[max(0, i - 40) : i]
    k = y.rfind("\n")
    if k >= 0:  # a line's words end with it unless one is broken
        line = y[k + 1 :]
        y = line if k and y[k - 1] not in SIGNS and line.strip() else _BROKEN.sub("", y)
    y = y.rsplit(None, 1)
    return y[-1].lstrip(_LEAD) if y else ""


def _first_word(x: str, i: int) -> str:
    """The word that begins behind i."""
    y, m = x, _NEXT_WORD.search(x, i, i + 60)
    if m is None:
        return ""
    if x[m.end() : m.end() + 1] in SIGNS:  # perhaps broken
        y = _BROKEN.sub("", x[i : i + 60])
        m = _NEXT_WORD.search(y)
        end = len(y)
    else:
        end = min(len(x), i + 60)
    # an initial isn't a word
    return m[0] + "." if len(m[0]) == 1 and m.end() < end and y[m.end()] == "." else m[0]


def _type(word: str) -> str:
    return _DIGITS.sub("#", word.lower())


@cache
def _beside(c: str) -> str:
    return "digit" if c.isdigit() else "upper" if c.isupper() else "letter" if c.isalpha() else "other"


@cache
def _next(c: str) -> str:
    if not c:
        return "end"
    if c in _OPEN or c in "\"'(¿¡[":
        return "opens"
    if c.isdigit():
        return "digit"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    return "letter" if c.isalpha() else "punct"


@dataclass(slots=True)
class Candidate:
    """``at`` is the last character of the sentence that would end here; ``kind`` names the mark, ``after`` what follows.

    ``word`` is the word before a full stop, ``following`` the capital word or the number behind it; ``settled`` is the tag that the
    orthography shows, None where it doesn't. ``digit`` tells of a digit beside it, and ``bare`` that it is
    a mark alone, which a script without punctuation would write as a blank. ``code`` stands for the context.
    """

    at: int
    kind: str
    after: str
    code: str
    settled: bool | None
    word: str = ""
    following: str = ""
    digit: bool = False
    bare: bool = False

    @property
    def context(self) -> tuple[str, ...]:
        return _context(self.code)

    def described(self, unspaced: bool) -> str:
        """All that the lexicon and the model see of it, in one line; words have no white space."""
        return f"{_head(self.code, self.settled, self.digit, self.bare, unspaced)}{self.word}\t{self.following}"


_TAGS = {True: "T", False: "F", None: "-"}
_TAG_OF = {t: s for s, t in _TAGS.items()}


@cache
def _head(code: str, settled: bool | None, digit: bool, bare: bool, unspaced: bool) -> str:
    return f"{code}\t{_TAGS[settled]}{digit:d}{bare:d}{unspaced:d}\t"


@cache
def _read_head(code: str, flags: str) -> tuple:
    kind, after = code.split(",", 2)[:2] if code else ("blank", "letter")
    return kind, after, _TAG_OF[flags[0]], flags[1] == "1", flags[2] == "1", flags[3] == "1"


@cache
def _context(code: str) -> tuple[str, ...]:
    if not code:
        return ()
    kind, nxt, gap, outer, open_, within, speech, ellipsis, before = code.split(",")
    flag = "1".__eq__
    return (
        f"k={kind},n={nxt},g={flag(gap)}", f"c={outer},n={nxt}", f"o={flag(open_)}", f"w={flag(within)}", f"s={flag(speech)}", f"e={flag(ellipsis)}",
        f"p={before},k={kind},n={nxt}",
    )


def restored(line: str) -> tuple[Candidate, bool]:
    """The candidate that was described, its place unknown, and whether its stream is unspaced."""
    code, flags, word, following = line.split("\t")
    kind, after, settled, digit, bare, unspaced = _read_head(code, flags)
    return Candidate(-1, kind, after, code, settled, word, following, digit, bare), unspaced


@dataclass
class Lexicon:
    """What the pages show of the words before full stops, and the words that begin sentences: mainly those written small elsewhere."""

    of_word: dict[str, str] = field(default_factory=dict)
    small: frozenset[str] = frozenset()
    dates: frozenset[str] = frozenset()

    def word(self, word: str) -> str:
        return self.of_word.get(_type(word), "rare")

    def following(self, c: Candidate) -> str:
        """A capital word may begin a sentence, or go with the number before it as in dates."""
        if c.following.lower() in self.small:
            return "ordinary"
        return "date" if c.following in self.dates and _type(c.word) == "#" else "other"


def candidates(x: str) -> list[Candidate]:
    """The places of a stream's text (lines joined by line feeds) that may end a sentence."""
    if not x.isascii() and len(_THAI.findall(x)) * 3 > len(x):
        return _blank_candidates(x)
    found = list(_MARK.finditer(x))
    inside = _quote_depths(x, [m.start() for m in found])
    out = []
    for m, quoted in zip(found, inside):
        (mark, close), (start, end) = m.groups(), m.span()
        if close and "“" in close and mark[-1] in "。！？":  # opens there, while it closes behind a Latin terminator
            close = close[: close.index("“")]
            end = start + len(mark) + len(close)
        c = x[end : end + 1]
        gap = not c or c.isspace()
        if gap:
            c = x[end + 1 : end + 2]
            if not c or c.isspace():
                after = _NORMAL.search(x, end)
                c = after[0] if after else ""
        nxt = _next(c)
        speech = bool(close) and _closes(close) and (c == "と" or (nxt == "letter" and _speech_follows(x, end)))
        before = x[start - 1] if start else ""
        kind, code, settled, bare = _judged(mark, close, nxt, gap, quoted, speech, _beside(before))
        stop, following = kind == "stop", ""
        if nxt == "upper" and (stop or kind == "strong"):
            following = _first_word(x, end)
        elif stop and nxt == "digit" and settled is None:
            following = _DIGITS.search(x, end)[0] if c.isdecimal() else c
        out.append(Candidate(end - 1, kind, nxt, code, settled, _last_word(x, start) if stop else "", following, before.isdigit() or c.isdigit(), bare))
    return out


@lru_cache(1 << 16)
def _judged(mark: str, close: str, nxt: str, gap: bool, quoted: bool, speech: bool, beside: str) -> tuple[str, str, bool | None, bool]:
    """(kind, code, settled, bare) of a mark with its closing marks, by what stands beside it."""
    kind = "cjk" if mark[-1] in "。！？" else "danda" if mark[-1] == "।" else "dots" if "…" in mark or mark.startswith("..") else "stop" if mark[-1] == "." else "strong"
    outer = "none" if not close else "outer" if _closes(close) else "inner"
    wide = nxt == "letter" or kind == "cjk" or (mark[0] == "…" and not gap)
    ellipsis = kind == "dots" and wide and len(mark) >= 2 and "…" in mark
    open_ = quoted and outer != "outer"
    within = not gap and not wide and not (nxt == "opens" and kind == "cjk")
    caseless = outer == "outer" and nxt == "letter"
    if nxt == "end":
        settled = None
    elif ellipsis or open_ or within or caseless or nxt in ("lower", "punct") or (kind == "stop" and nxt == "letter"):
        settled = False
    else:
        settled = True if kind != "stop" else None
    code = f"{kind},{nxt},{gap:d},{outer},{open_:d},{within:d},{speech:d},{ellipsis:d},{beside}"
    return kind, code, settled, outer == "none" and not open_ and not ellipsis


def _closes(close: str) -> bool:
    """Whether closing marks end an outer quotation."""
    return not _CLOSING.isdisjoint(close)


def _speech_follows(x: str, end: int) -> bool:
    """Whether the clause behind a quotation names its speaker, or isn't finished in this stream."""
    clause = x[end : end + 160]
    stop = re.search("[。।？！?!]", clause)
    if stop is None:
        return end + 160 >= len(x)
    return bool(SPEECH.search(re.sub(r"\s+", lambda m: " " if "ऀ" < clause.lstrip()[:1] < "ঀ" else "", clause[: stop.end()])))


def _blank_candidates(x: str) -> list[Candidate]:
    out = []
    for m in _BLANK.finditer(x):
        i, j = m.start(), m.end()
        after = _NORMAL.search(x, j)
        a, b = x[:i].rstrip()[-1:] if i and x[i - 1].isspace() else x[i - 1 : i], after[0] if after else ""
        if not a:
            continue
        out.append(Candidate(i - 1, "blank", "letter", "", None, digit=a.isdigit() or b.isdigit()))
    return out


def _blank(c: Candidate, unspaced: bool) -> tuple[str, ...]:
    """A candidate known by its neighbours only, as a blank in text without punctuation."""
    return ("k=blank", f"digit={c.digit}", f"digit={c.digit},unspaced={unspaced}")


def features(c: Candidate, lexicon: Lexicon) -> tuple[str, ...]:
    if c.kind == "blank":
        return _blank(c, True)
    if c.kind != "stop":
        return c.context
    low = c.word.lower()
    known = lexicon.word(c.word)
    listed = "may" if low in MAY_END else "on" if low in GOES_ON or ("." in low and low.split(".")[-1] in GOES_ON) else "no"
    size = min(len(c.word), 5)
    shape = f"{size}{'v' if _VOWEL.search(low) else '-'}{'C' if c.word[:1].isupper() else '-'}{'#' if any(x.isdigit() for x in c.word) else '-'}"
    nxt = c.after if c.after != "upper" else f"upper-{lexicon.following(c)}"
    return _stop(c.code, known, listed, shape, nxt)


@cache
def _stop(code: str, known: str, listed: str, shape: str, nxt: str) -> tuple[str, ...]:
    return (*_context(code), f"t={known}", f"t={known},n={nxt}", f"l={listed}", f"l={listed},n={nxt}", f"z={shape}", f"z={shape},t={known}", f"n={nxt}")


def learn_words(streams: list[tuple[str, list[Candidate]]], least: int = 3) -> Lexicon:
    """The words of the streams: which are written small, and which go on over a full stop.

    A word of which the capital words behind it, compared with those behind other marks, or its use
    without a full stop don't tell enough isn't listed.
    """
    small: Counter[str] = Counter()
    large: Counter[str] = Counter()
    plain: Counter[str] = Counter()
    for x, _ in streams:
        y = _BROKEN.sub("", x)
        for w in _WORD.findall(y):
            (small if w.islower() else large)[w] += 1
        plain.update(_type(w) for w in (t.lstrip(_LEAD).rstrip(_TAIL) for t in y.split()) if w and w[-1] != ".")
    ordinary = frozenset(w for w, n in small.items() if n >= 2)
    of_word = _words_before(streams, ordinary, plain, least)
    # words that stand mostly where sentences begin for certain begin sentences elsewhere too
    first: Counter[str] = Counter()
    for _, cs in streams:
        first.update(c.following for c in cs if c.after == "upper" and (c.settled if c.kind != "stop" else of_word.get(_type(c.word)) == "ends"))
    begin = frozenset(w.lower() for w, n in first.items() if n >= least and n >= 0.5 * large[w])
    if begin:
        ordinary |= begin
        of_word = _words_before(streams, ordinary, plain, least)
    dates = Counter(c.following for _, cs in streams for c in cs if c.after == "upper" and c.kind == "stop" and _type(c.word) == "#")
    return Lexicon(of_word, ordinary, frozenset(w for w, n in dates.items() if n >= least and w.lower() not in ordinary))


def _words_before(streams: list[tuple[str, list[Candidate]]], ordinary: frozenset[str], plain: Counter[str], least: int) -> dict[str, str]:
    inside: Counter[str] = Counter()
    numbers: dict[str, Counter[str]] = {}
    capitals: dict[str, Counter[str]] = {}
    strong = [0, 0]
    for _, cs in streams:
        for c in cs:
            common = c.following.lower() in ordinary
            if c.kind == "stop":
                t = _type(c.word)
                if c.settled is False:
                    inside[t] += "o=True" not in c.context  # an open quotation says nothing of the word
                elif c.after == "upper":
                    capitals.setdefault(t, Counter())[c.following] += 1
                elif c.after == "digit":
                    numbers.setdefault(t, Counter())[c.following] += 1
            elif c.kind == "strong" and c.settled and c.after == "upper":
                strong[0 if common else 1] += 1
    base = (strong[0] + 1) / (strong[0] + strong[1] + 2)
    of_word = {}
    for w in {*inside, *numbers, *capitals}:
        after = capitals.get(w, Counter())
        digits = numbers.get(w, Counter())
        varied = sum(k if i > 1 else 1 for i, (_, k) in enumerate(digits.most_common()))
        common = sum(k for f, k in after.items() if f.lower() in ordinary)
        top = sum(sorted((k for f, k in after.items() if f[-1:] != "."), reverse=True)[:2])
        use = _use(w, inside[w], digits.total(), varied, after.total(), common, top, plain[w], base, least)
        if use:
            of_word[w] = use
    return of_word


def _use(w: str, inside: int, digits: int, varied: int, n: int, common: int, top: int, plain: int, base: float, least: int) -> str | None:
    """How a word of these counts is used: ``n`` capital words behind it, ``common`` ordinary ones, ``top`` the two most frequent;
    ``digits`` numbers, ``varied`` if the two most frequent count once."""
    # the share of capital words that begin a sentence, if as many of those are ordinary as elsewhere
    rate = min(1.0, common / (base * n)) if n >= least else None
    usual = "#" not in w and plain >= max(2, 0.3 * (inside + digits + n))
    # one phrase that is repeated says nothing of the word, unless it is an abbreviation too
    phrase = top > 0.6 * n
    if usual:
        digits = varied
    if digits >= 4 * max(n, least):
        return "on"
    if rate is not None and (rate >= 0.4 or common >= least and rate >= 0.2 or usual):
        return "ends" if inside <= 0.1 * n else "may"
    if rate is not None and not phrase or inside >= max(least, n) or digits >= max(least, n) and not usual:
        return "on"
    return None


def shown_tag(c: Candidate, lexicon: Lexicon) -> bool | None:
    """The tag of a candidate as far as its orthography and its word's other uses show it."""
    if c.settled is not None or c.kind in ("blank", "dots") or c.after == "end":
        return c.settled
    known, following = lexicon.word(c.word), lexicon.following(c) if c.after == "upper" else ""
    ordinary = following == "ordinary"
    if following == "date":
        return False
    if known == "on":
        return None if ordinary or c.after == "opens" else False
    if known == "ends":
        return True
    return True if ordinary or (known == "may" and c.after != "upper") else None


@dataclass
class Model:
    """Emission weights by feature, and scores of a boundary soon after another one or a new stream."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    near: float = 0.0
    near_length: int = 4
    lexicon: Lexicon = field(default_factory=Lexicon)

    def features(self, c: Candidate) -> tuple[str, ...]:
        return features(c, self.lexicon)

    def score(self, names: tuple[str, ...]) -> float:
        w = self.weights
        return self.bias + sum(w.get(f, 0.0) for f in names)

    def emission(self, c: Candidate) -> float:
        return self.score(self.features(c))


NEAR = Model.near_length


def _unspaced(x: str) -> bool:
    return len(_BLANK.findall(x)) * 12 < len(x)


def _chains(cs: list[Candidate], lines: list[str]) -> list[str]:
    """The line of each candidate and those of the ones that stand near before it, the nearest first."""
    out = list(lines)
    for i in range(1, len(cs)):
        j = i - 1
        while j >= 0 and cs[i].at - cs[j].at <= NEAR:
            out[i] += "\n" + lines[j]
            j -= 1
    return out


@dataclass
class Tally:
    """Counts of the features of candidates with a shown tag, ``True`` or ``False``, and of boundaries near others."""

    seen: Counter[tuple[tuple[str, ...], bool]] = field(default_factory=Counter)
    near: int = 0
    near_ends: int = 0
    ends: int = 0
    n: int = 0

    def add(self, chain: str, times: int, lexicon: Lexicon) -> None:
        line, *before = chain.split("\n")
        c, unspaced = restored(line)
        tag = shown_tag(c, lexicon)
        if tag is None:
            return
        self.seen[features(c, lexicon), tag] += times
        if c.bare:
            self.seen[_blank(c, unspaced), tag] += times  # the same place with its punctuation taken out
        self.n += times
        self.ends += tag * times
        # whether the last one that has a tag is a boundary
        last = next((t for t in (shown_tag(restored(b)[0], lexicon) for b in before) if t is not None), False)
        if last:
            self.near += times
            self.near_ends += tag * times


def fit(streams: Iterator[str]) -> Model:
    """The model of the streams' texts."""
    read = [(x, candidates(x)) for x in streams]
    lexicon, tally = learn_words(read), Tally()
    for x, cs in read:
        unspaced = _unspaced(x)
        for chain in _chains(cs, [c.described(unspaced) for c in cs]):
            tally.add(chain, 1, lexicon)
    return weighed(tally, lexicon)


def weighed(tally: Tally, lexicon: Lexicon, steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Log-linear emissions by gradient ascent over the candidates whose tag is shown, transitions from their counts."""
    model = Model(lexicon=lexicon)
    seen = sorted(tally.seen.items())  # sums of floats are the same in any order of the pages
    if not seen:
        return model
    index: dict[str, int] = {}
    rows = [[index.setdefault(f, len(index)) for f in names] for (names, _), _ in seen]
    X = np.zeros((len(seen), len(index)))
    for i, row in enumerate(rows):
        np.add.at(X[i], row, 1.0)
    y = np.array([tag for (_, tag), _ in seen], float)
    m = np.sqrt(np.array([k for _, k in seen], float) / tally.seen.total())
    m /= m.sum()
    w, b = np.zeros(len(index)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ w + b, -30, 30)))
        g = (y - p) * m
        w += rate * 10 * (X.T @ g - decay * w)
        b += rate * 10 * g.sum()
    model.weights = {f: round(float(w[i]), 6) for f, i in index.items()}
    model.bias = float(b)
    model.near = float(np.log((tally.near_ends + 0.5) / (tally.near + 1.0)) - np.log((tally.ends + 0.5) / (tally.n + 1.0)))
    model.near = min(model.near, 0.0)
    return model


def viterbi(score: np.ndarray, at: np.ndarray, sequence: np.ndarray, model: Model) -> np.ndarray:
    """The best tags (True is boundary) of many sequences at once; ``sequence`` ascends."""
    n = len(score)
    if not n:
        return np.empty(0, bool)
    first = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
    size = np.diff(np.r_[first, n])
    inside, boundary = np.zeros(len(first)), np.zeros(len(first))
    back = np.zeros((n, 2), bool)  # whether the best way to (inside, boundary) comes from a boundary
    for t in range(int(size.max())):
        live = np.flatnonzero(size > t)
        i = first[live] + t
        if t == 0:
            inside[live], boundary[live] = 0.0, score[i]
            continue
        close = np.where(at[i] - at[i - 1] <= model.near_length, model.near, 0.0)
        a, b = inside[live], boundary[live]
        back[i, 0] = b > a
        back[i, 1] = b + close > a
        inside[live] = np.maximum(a, b)
        boundary[live] = np.maximum(a, b + close) + score[i]
    tags = np.zeros(n, bool)
    now = boundary > inside
    for t in range(int(size.max()) - 1, -1, -1):
        live = np.flatnonzero(size > t)
        i = first[live] + t
        tags[i] = now[live]
        now[live] = back[i, now[live].astype(int)]
    return tags


def _streams(b: pa.RecordBatch, at: int) -> layout.Streams:
    return layout.read(b.column(at).to_pylist(), *(b.column(at + 1 + i) for i in range(4)))


def _texts(s: layout.Streams) -> list[str]:
    last = [*s.first[1:].tolist(), len(s.lines)]
    return ["\n".join(s.lines[a:b]) for a, b in zip(s.first.tolist(), last)]


@dataclass
class Places:
    """Candidates of a batch in reading order, and the ends of its streams; places are code points of documents.

    ``step`` is the distance to the candidate before, 0 for the first of a stream.
    """

    seen: list[str]
    doc: np.ndarray
    place: np.ndarray
    step: np.ndarray
    end_doc: np.ndarray
    end: np.ndarray


def places(s: layout.Streams, counts: Counts | None = None) -> Places:
    seen, at, step, stream, final, final_of = [], [], [], [], [], []
    for n, x in enumerate(_texts(s)):
        stripped = len(x.rstrip())
        if not stripped:
            continue
        final.append(stripped - 1)
        final_of.append(n)
        if s.kind[n] == layout.HEADLINE:
            continue
        cs = candidates(x)
        while cs and cs[-1].at >= stripped - 1:  # nothing follows: the end itself, which has no tag to learn from
            cs.pop()
        unspaced = _unspaced(x)
        lines = [c.described(unspaced) for c in cs]
        if counts is not None:
            counts.add(x, cs, lines)
        seen += lines
        here = [c.at for c in cs]
        at += here
        step += [0, *(b - a for a, b in zip(here, here[1:]))][: len(here)]
        stream += [n] * len(cs)
    place, of = np.array(at + final, np.int64), np.array(stream + final_of, np.int64)
    # from places in joined streams to places in documents
    length = np.fromiter(map(len, s.lines), np.int64, len(s.lines)) + 1
    begin = np.cumsum(length) - length
    if len(place):
        whole = begin[s.first[of]] + place
        line = np.searchsorted(begin, whole, side="right") - 1
        place, of = s.offset[line] + whole - begin[line], s.doc[of]
    k = len(seen)
    return Places(seen, of[:k], place[:k], np.array(step, np.int64), of[k:], place[k:])


def boundaries(seen: list[str], step: np.ndarray, model: Model, scores: dict[str, float]) -> np.ndarray:
    """Which of the candidates are boundaries; ``scores`` keeps what was computed before."""
    if len(scores) > COUNTED:
        scores.clear()
    score = np.empty(len(seen))
    for i, line in enumerate(seen):
        e = scores.get(line)
        if e is None:
            e = scores[line] = model.emission(restored(line)[0])
        score[i] = e
    return viterbi(score, np.cumsum(step), np.cumsum(step == 0), model)


def ends_of(s: layout.Streams, model: Model, scores: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, code point) of the last character of every sentence of a batch."""
    p = places(s)
    keep = boundaries(p.seen, p.step, model, {} if scores is None else scores)
    return np.r_[p.doc[keep], p.end_doc], np.r_[p.place[keep], p.end]


class Counts:
    """Counts of the tokens and candidates of streams, as rows ``role, word, following, low, chain, n``.

    Roles of words: ``small``, ``large``, and ``plain`` for those without a full stop. Roles of candidates:
    ``inside``, ``digit`` and ``capital`` for full stops that tell of the word before them, ``strong`` for
    question and exclamation marks before a capital word, and ``other``. ``word`` is that before a full stop.
    """

    def __init__(self) -> None:
        self.tokens: Counter[str] = Counter()
        self.chains: Counter[str] = Counter()

    def __len__(self) -> int:
        return max(len(self.tokens), len(self.chains))

    def add(self, x: str, cs: list[Candidate], lines: list[str]) -> None:
        self.tokens.update(_BROKEN.sub("", x).split())
        if cs and cs[0].kind != "blank":
            self.chains.update(_chains(cs, lines))

    def rows(self) -> list[list]:
        words: Counter[tuple[str, str]] = Counter()
        for t, n in self.tokens.items():
            for w in _WORD.findall(t):
                # of large ones only those that begin with a capital are looked up
                if w.islower():
                    words["small", w] += n
                elif w[0].isupper():
                    words["large", w] += n
            w = t.lstrip(_LEAD).rstrip(_TAIL)
            if w and w[-1] != ".":
                words["plain", _type(w)] += n
        # longer ones can't stand beside a mark, see _last_word and _first_word; of types with numbers _use needs no plain ones
        out = [[role, w, None, None, None, n] for (role, w), n in words.items() if len(w) <= 80 and "#" not in w]
        for chain, n in self.chains.items():
            c, _ = restored(chain.split("\n", 1)[0])
            role = _role(c)
            out.append([role, _type(c.word) if c.kind == "stop" else None, c.following, c.following.lower(), chain, n])
        self.tokens.clear()
        self.chains.clear()
        return out


def _role(c: Candidate) -> str:
    if c.kind == "stop":
        if c.settled is False:
            return "other" if "o=True" in c.context else "inside"  # an open quotation says nothing of the word
        return {"upper": "capital", "digit": "digit"}.get(c.after, "other")
    return "strong" if c.kind == "strong" and c.settled and c.after == "upper" else "other"


def read_pages(df: DataFrame, key: str, text: str, boxes: str) -> DataFrame:
    """All pages read, once: rows of ``doc_id, ends, place, step, seen`` with a page's places, and rows of counts."""
    kind = df.schema[key].dataType.simpleString()
    of_page = f"doc_id {kind}, ends array<long>, place array<long>, step array<long>, seen string"
    of_counts = "role string, word string, following string, low string, chain string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, like = Counts(), None

        def counted() -> Iterator[pa.RecordBatch]:
            rows = counts.rows()
            for i in range(0, len(rows), 50_000):
                columns = list(zip(*rows[i : i + 50_000]))
                n = len(columns[0])
                none = [pa.nulls(n, t) for t in (like, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())]
                yield pa.RecordBatch.from_arrays([*none, *(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.int64())], names)

        names = ["doc_id", "ends", "place", "step", "seen", "role", "word", "following", "low", "chain", "n"]
        for b in batches:
            like = b.column(0).type
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                p = places(_streams(part, 1), counts)
                docs = np.arange(part.num_rows + 1)
                at, end_at = np.searchsorted(p.doc, docs), np.searchsorted(p.end_doc, docs)
                lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v)) for o, v in ((end_at, p.end), (at, p.place), (at, p.step))]
                seen = ["\n".join(p.seen[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                none = [pa.nulls(part.num_rows, pa.string())] * 5
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(seen, pa.string()), *none, pa.nulls(part.num_rows, pa.int64())], names)
                if len(counts) > COUNTED:
                    yield from counted()
        yield from counted()

    chosen = df.select(F.col(key), F.col(text).alias("t_"), *_boxes(df, boxes))
    return materialise(chosen.mapInArrow(run, f"{of_page}, {of_counts}"), "pages")


def learned(pages: DataFrame, least: int = 3) -> Lexicon:
    """``learn_words`` of all pages, from their counts. Only words that stand beside marks come to the driver."""
    useful = pages.filter("role in ('small', 'large', 'plain', 'inside', 'digit', 'capital', 'strong') or role = 'other' and word is not null and following <> ''")
    summed = materialise(useful.groupBy("role", "word", "following", "low").agg(F.sum("n").alias("n")), "counts")
    behind = summed.filter("following <> '' and role <> 'digit'")  # capital words behind marks
    beside = behind.select("low").distinct()
    ordinary = summed.filter("role = 'small' and n >= 2").select(F.col("word").alias("low")).join(beside, "low", "left_semi")
    ordinary = materialise(ordinary, "ordinary")
    large = summed.filter("role = 'large'").select(F.col("word").alias("following"), F.col("n").alias("anywhere"))

    of_word = _words_of_counts(summed, ordinary, least)
    ends = pages.sparkSession.createDataFrame(pa.table({"word": pa.array([w for w, use in of_word.items() if use == "ends"], pa.string())}))
    first = behind.join(ends, "word", "left_semi").unionByName(behind.filter("role = 'strong'"))
    first = first.groupBy("following", "low").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    begin = first.join(large, "following", "left").filter(F.col("n") >= 0.5 * F.coalesce("anywhere", F.lit(0))).select("low").distinct()
    begin = materialise(begin.join(ordinary, "low", "left_anti"), "begin")
    if not begin.isEmpty():
        ordinary = ordinary.unionByName(begin)
        of_word = _words_of_counts(summed, ordinary, least)
    small = beside.join(ordinary, "low", "left_semi").toArrow()
    dates = behind.filter("word = '#'").groupBy("following", "low").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    dates = dates.join(ordinary, "low", "left_anti").select("following").toArrow()
    return Lexicon(of_word, frozenset(small.column(0).to_pylist()), frozenset(dates.column(0).to_pylist()))


def _words_of_counts(summed: DataFrame, ordinary: DataFrame, least: int) -> dict[str, str]:
    """``_words_before`` of summed counts."""
    known = ordinary.withColumn("common", F.lit(True))
    n = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    strong = summed.filter("role = 'strong'").join(known, "low", "left").agg(n(F.col("common")), n(F.col("common").isNull())).first()
    base = ((strong[0] or 0) + 1) / ((strong[0] or 0) + (strong[1] or 0) + 2)
    whole = ~F.col("following").endswith(".")
    order = Window.partitionBy("role", "word").orderBy(whole.desc(), F.col("n").desc())
    capital = summed.filter("role in ('capital', 'digit')").join(known, "low", "left").withColumn("top", whole & (F.row_number().over(order) <= 2))
    rest = summed.filter("role in ('inside', 'plain')")
    by_word = capital.unionByName(rest, allowMissingColumns=True).groupBy("word").agg(
        n(F.col("role") == "inside").alias("inside"), n(F.col("role") == "digit").alias("digits"),
        F.sum(F.when(F.col("role") == "digit", F.when(F.col("top"), 1).otherwise(F.col("n"))).otherwise(0)).alias("varied"), n(F.col("role") == "capital").alias("n"),
        n(F.col("common")).alias("common"), n(F.col("top") & (F.col("role") == "capital")).alias("top"), n(F.col("role") == "plain").alias("plain"),
    )
    told = by_word.filter(F.greatest("inside", "digits", "n") >= least).toArrow()
    uses = ((w, _use(w, *counts, base, least)) for w, *counts in zip(*(c.to_pylist() for c in told.columns)))
    return {w: use for w, use in uses if use}


def fit_pages(pages: DataFrame) -> Model:
    """The model of all pages of ``read_pages``: as many rows come to the driver as there are kinds of candidates."""
    lexicon = learned(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in batches:
            for chain, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tally.add(chain, n, lexicon)
        rows = [("\n".join(names), tag, n) for (names, tag), n in tally.seen.items()]
        rows += [(name, None, getattr(tally, name)) for name in ("near", "near_ends", "ends", "n")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.int64()))], ["names", "tag", "n"])

    chains = pages.filter(F.col("chain").isNotNull()).select("chain", "n")
    found = chains.mapInArrow(run, "names string, tag boolean, n long").groupBy("names", "tag").agg(F.sum("n").alias("n")).toArrow()
    tally = Tally()
    for names, tag, n in zip(*(c.to_pylist() for c in found.columns)):
        if tag is None:
            setattr(tally, names, n)
        else:
            tally.seen[tuple(names.split("\n")), tag] = n
    return weighed(tally, lexicon)


def page_ends(pages: DataFrame, model: Model) -> DataFrame:
    """``sentence_ends`` of the pages of ``read_pages``."""
    kind = pages.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: dict[str, float] = {}
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                seen = [line for x in part.column(4).to_pylist() if x for line in x.split("\n")]
                ends, place, step = (c.flatten().to_numpy() for c in part.columns[1:4])
                docs = np.arange(part.num_rows)
                end_doc, doc = (np.repeat(docs, c.value_lengths().to_numpy()) for c in part.columns[1:3])
                keep = boundaries(seen, step, model, scores)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.r_[doc[keep], end_doc])), pa.array(np.r_[place[keep], ends])], ["doc_id", "end_at"])

    return pages.filter("role is null").select("doc_id", "ends", "place", "step", "seen").mapInArrow(run, f"doc_id {kind}, end_at long")


def _boxes(df: DataFrame, boxes: str) -> list:
    return [F.col(f"{boxes}.{c}").alias(f"{c}_") for c in ("x0", "y0", "x1", "y1")]


def fit_on(df: DataFrame, key: str, text: str, boxes: str, pages: int | None = None) -> Model:
    """The model of a table: fitted on all its pages, or on the ``pages`` whose key has the smallest hash if a caller asks for that."""
    if pages is not None:
        df = df.filter(F.col(text).isNotNull()).orderBy(F.xxhash64(key), text).limit(pages)
    return fit_pages(read_pages(df, key, text, boxes))


def sentence_ends(df: DataFrame, key: str, text: str, boxes: str, model: Model) -> DataFrame:
    """``doc_id, end_at`` of every sentence: the code point of its last character, closing marks included.

    Null, empty and blank texts have none. A page without a box for every line is read as one
    column. Repeated rows give repeated sentences. Columns other than those named are ignored.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: dict[str, float] = {}
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                doc, at = ends_of(_streams(part, 1), model, scores)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(at)], ["doc_id", "end_at"])

    chosen = df.select(F.col(key), F.col(text).alias("t_"), *_boxes(df, boxes))
    return chosen.mapInArrow(run, f"doc_id {kind}, end_at long")


def sentences(df: DataFrame, key: str, text: str, boxes: str, model: Model) -> DataFrame:
    """``doc_id, sentence_no, end_at, sentence``: the sentences in reading order, words broken at line ends made whole."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: dict[str, float] = {}
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                s = _streams(part, 1)
                doc, at = ends_of(s, model, scores)
                stops = np.sort(doc * (1 << 40) + at)
                last = [*s.first[1:].tolist(), len(s.lines)]
                docs, numbers, places, texts, count = [], [], [], [], {}
                for n, (a, z) in enumerate(zip(s.first.tolist(), last)):
                    d, held = int(s.doc[n]), ""
                    for k in range(a, z):
                        start, line = 0, s.lines[k]
                        o = int(s.offset[k])
                        lo, hi = np.searchsorted(stops, [(d << 40) + o, (d << 40) + o + len(line)])
                        for p in (stops[lo:hi] - (d << 40) - o).tolist():
                            docs.append(d)
                            numbers.append(count.get(d, 0))
                            places.append(o + p)
                            texts.append(joined(held + line[start : p + 1]))
                            count[d] = count.get(d, 0) + 1
                            held, start = "", p + 1
                        held += line[start:] + "\n"
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs, pa.int64())), pa.array(numbers, pa.int32()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "sentence_no", "end_at", "sentence"])

    chosen = df.select(F.col(key), F.col(text).alias("t_"), *_boxes(df, boxes))
    return chosen.mapInArrow(run, f"doc_id {kind}, sentence_no int, end_at long, sentence string")


_WIDE = re.compile("(?<=[฀-๿　-ヿ㐀-鿿＀-￯])\n+(?=[฀-๿　-ヿ㐀-鿿＀-￯\"“”「」])")


def joined(x: str) -> str:
    """Lines made one: broken words are put together, scripts without blanks get none."""
    return re.sub(r"\s+", " ", _WIDE.sub("", _BROKEN.sub("", x))).strip()
