"""Reading order of scanned pages: columns, headlines, articles and adverts.

A page is a text of lines and a box for each line. Lines whose left edges lie close together are a
column, read downwards. Lines much taller than the page's body lines are headlines; lines lower
than those and set in are adverts. What can be read on without a break is a stream: the article
lines of a column between its headlines, a run of advert lines, or a run of headline lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

ARTICLE, ADVERT, HEADLINE = 0, 1, 2

#: In multiples of the height of a body line: least step between columns, least inset of adverts,
#: least height of a headline, greatest height of an advert.
COLUMN_STEP, INSET, TALL, LOW = 3.0, 0.4, 1.4, 0.9


@dataclass
class Streams:
    """Lines of a batch in reading order. ``stream`` ascends; ``kind`` and ``doc`` are by stream."""

    lines: list[str]
    offset: np.ndarray  # code point at which the line begins in its document's text
    stream: np.ndarray
    kind: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # number of each stream's first line


def _low_median(value: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """By group; groups without values give nan."""
    order = np.lexsort((value, group))
    g = group[order]
    first = np.searchsorted(g, np.arange(n))
    size = np.searchsorted(g, np.arange(n), side="right") - first
    out = np.full(n, np.nan)
    has = size > 0
    out[has] = value[order][first[has] + (size[has] - 1) // 2]
    return out


def _flat(column: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Values of the lists whose row is wanted."""
    off = np.asarray(column.offsets)  # of a slice they don't begin at 0
    values = column.values[int(off[0]) : int(off[-1])].to_numpy(zero_copy_only=False)
    return values[np.repeat(wanted, np.diff(off))]


def read(texts: list[str | None], x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> Streams:
    """The streams of pages. A page without a box for every line is one column of article lines."""
    split = [t.split("\n") if t else [] for t in texts]
    count = np.array([len(s) for s in split], np.int64)
    boxes = np.asarray(x0.value_lengths().fill_null(0))
    boxed = (count > 0) & (boxes == count)
    n, docs = int(count.sum()), len(texts)
    doc = np.repeat(np.arange(docs), count)
    lines = [line for s in split for line in s]
    size = np.fromiter(map(len, lines), np.int64, n)
    total = np.cumsum(size + 1) - size - 1
    head = np.cumsum(count) - count
    number = np.arange(n) - head[doc]
    offset = total - total[head[doc]] if n else total
    if not n:
        none = np.empty(0, np.int64)
        return Streams([], none, none, none, none, none)

    have = boxed[doc]
    left, top = np.zeros(n), number * 10.0
    height = np.full(n, 10.0)
    if have.any():
        box = [_flat(c, boxed).astype(float) for c in (x0, y0, y1)]
        left[have], top[have], height[have] = box[0], box[1], box[2] - box[1]
    left = np.nan_to_num(left)
    top = np.nan_to_num(top)
    height = np.nan_to_num(height, nan=10.0)

    base = _low_median(height, doc, docs)
    order = np.lexsort((left, doc))
    jump = np.r_[True, (np.diff(left[order]) > COLUMN_STEP * base[doc[order][1:]]) | (np.diff(doc[order]) > 0)]
    column = np.empty(n, np.int64)
    column[order] = np.cumsum(jump) - 1
    edge = np.full(column.max() + 1, np.inf)
    np.minimum.at(edge, column, left)
    inset = left - edge[column] >= INSET * base[doc]
    flush = ~inset
    body = _low_median(height[flush], doc[flush], docs)
    body = np.where(np.isnan(body), base, body)[doc]
    kind = np.where(height >= TALL * body, HEADLINE, np.where((height <= LOW * body) & inset, ADVERT, ARTICLE))

    order = np.lexsort((number, top, column))
    c, k = column[order], kind[order]
    new_column = np.r_[True, c[1:] != c[:-1]]
    # articles run on over adverts but not over headlines; runs of the other two are streams
    heads = np.r_[False, k[1:] == HEADLINE] & np.r_[False, k[:-1] != HEADLINE] | (k == HEADLINE) & np.r_[True, k[:-1] != HEADLINE]
    section = np.cumsum(new_column | heads)
    run = np.cumsum(new_column | np.r_[True, k[1:] != k[:-1]])
    label = np.where(k == ARTICLE, section * 2, run * 2 + 1)
    # by first line: an article's stream stands where it begins
    regroup = np.lexsort((np.arange(n), label, k == ARTICLE, c))
    order = order[regroup]
    lab, c, k = label[regroup], c[regroup], k[regroup]
    fresh = np.r_[True, (lab[1:] != lab[:-1]) | (c[1:] != c[:-1])]
    first = np.flatnonzero(fresh)
    return Streams([lines[i] for i in order], offset[order], np.cumsum(fresh) - 1, k[first], doc[order][first], first)
