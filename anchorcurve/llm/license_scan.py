"""License scans by patience alignment of texts with license templates.

Words that stand once in both the region and the template are anchors; the longest increasing subsequence of their
places is kept, and the gaps between anchors are aligned the same way.  Coverage is the share of the template's words
that are aligned; likeness also counts what the region holds beside them, so insertions tell against a template.

What makes another license must agree in full: version numbers and the words of DECISIVE are aligned one and all, in
the template and in the region.  Of templates that claim the same words the one with most aligned words is kept.
Before that, a text's words bound the coverage a template can reach, so few texts are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import DECISIVE, TEMPLATES

_WORD = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")


def words(text: str) -> list[str]:
    """Lower-case runs of letters and numbers.  A version number, one with a point, after ``version`` or ``v``, or before
    ``clause``, is written ``#`` and its digits, without ``.0`` at the end; list marks and years stay plain numbers."""
    out = _WORD.findall(text.lower())
    for i, w in enumerate(out):
        if w[0].isdigit() and ("." in w or out[i - 1 : i] in (["version"], ["v"]) or out[i + 1 : i + 2] == ["clause"]):
            out[i] = "#" + re.sub(r"(\.0+)+$", "", w)
    return out


def decisive(word: str) -> bool:
    return word[0] == "#" or word in DECISIVE


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by piles."""
    tops: list[int] = []
    at: list[int] = []
    below = [-1] * len(places)
    for i, v in enumerate(places):
        k = bisect_left(tops, v)
        below[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both lists."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            out.append((j - 1, m - 1))
            j, m = j - 1, m - 1
        if i >= j or k >= m:
            continue
        left, right = {}, {}
        for p in range(i, j):
            left[a[p]] = p if a[p] not in left else -1
        for p in range(k, m):
            right[b[p]] = p if b[p] not in right else -1
        both = sorted((p, right[w]) for w, p in left.items() if p >= 0 and right.get(w, -1) >= 0)
        anchors = [both[x] for x in _increasing([q for _, q in both])]
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)]):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


@dataclass
class Template:
    name: str
    words: list[str]

    def __post_init__(self):
        self.bag, self.distinct = Counter(self.words), set(self.words)
        self.decisive = [k for k, w in enumerate(self.words) if decisive(w)]


@dataclass
class Match:
    template: str
    aligned: int
    coverage: float
    likeness: float
    first: int
    last: int
    places: int = 1


def _best_part(pairs: list[tuple[int, int]], n: int, least: float) -> tuple[int, int, float]:
    """(from, to, likeness) of the run of pairs that is most like a template of n words: stray words at the ends go."""
    need, best = -(-least * n // 1), (0, 0, 0.0)
    for i in range(len(pairs)):
        for j in range(len(pairs), i, -1):
            if j - i < need:
                break
            like = 2 * (j - i) / (n + pairs[j - 1][0] - pairs[i][0] + 1)
            if like > best[2]:
                best = (i, j, like)
    return best


def regions(own: list[str], t: Template, least: float):
    """Yields Matches of t, left to right and apart: windows that hold enough of its words, aligned."""
    n, size = len(t.words), int(1.5 * len(t.words)) + 2
    need = least * n
    have: Counter[str] = Counter()
    over, s, e = 0, 0, 0

    def drop(to: int) -> None:
        nonlocal s, over
        while s < to:
            w = own[s]
            if w in t.bag:
                have[w] -= 1
                over -= have[w] < t.bag[w]
            s += 1

    while e < len(own):
        w = own[e]
        if w in t.bag:
            have[w] += 1
            over += have[w] <= t.bag[w]
        e += 1
        drop(max(s, e - size))
        # Go on while the window may still get better: to its full size, or to the end of the text.
        if over < need or (over < n and e - s < size and e < len(own)):
            continue
        window = own[s:e]
        pairs = align(window, t.words)
        i, j, like = _best_part(pairs, n, least)
        if j - i >= need and like >= least:
            part = pairs[i:j]
            first, last = part[0][0], part[-1][0]
            if [q for _, q in part if decisive(t.words[q])] == t.decisive and sum(map(decisive, window[first : last + 1])) == len(t.decisive):
                yield Match(t.name, j - i, (j - i) / n, like, s + first, s + last)
                drop(s + last + 1)
                continue
        drop(min(e, s + max(1, n // 8)))


def scan_text(text: str, templates: list[Template], least: float) -> list[Match]:
    """Best match of each template that reaches ``least`` coverage and likeness, and how many places it has.

    Places where several templates claim a word go to the one with most aligned words (then likeness, then name).
    """
    own = words(text)
    held, found = set(own), []
    for t in templates:
        # So many of its words may be missing at most.
        if len(t.distinct & held) >= len(t.distinct) - int(len(t.words) - least * len(t.words)):
            found += regions(own, t, least)
    taken: list[Match] = []
    for m in sorted(found, key=lambda m: (-m.aligned, -m.likeness, m.template, m.first)):
        if all(m.last < o.first or m.first > o.last for o in taken):
            taken.append(m)
    out: dict[str, Match] = {}
    for m in sorted(taken, key=lambda m: (-m.coverage, -m.likeness, m.first)):
        if m.template in out:
            out[m.template].places += 1
        else:
            out[m.template] = m
    return sorted(out.values(), key=lambda m: m.template)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, template, coverage, likeness, first_word, last_word, n_places for each template that a text holds.

    Places are those of words(text); of equally good ones the first counts.  Null, empty and unmatched texts give no
    row; repeated rows give theirs each; whole texts are read, however long; an empty table gives no rows; other columns
    don't matter, whatever their names.
    """
    split = [Template(k, words(t)) for k, t in (templates or TEMPLATES).items()]
    names = ["id", "template", "coverage", "likeness", "first_word", "last_word", "n_places"]
    kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())

    def fn(batches):
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if t:
                    rows += [(i, m.template, m.coverage, m.likeness, m.first, m.last, m.places) for m in scan_text(t, split, least)]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(fn, "id long, template string, coverage double, likeness double, first_word long, last_word long, n_places long")
