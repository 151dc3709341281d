"""Language identification by cross-parsing: longest matches against a suffix automaton per language.

A text is read left to right; while the automaton of a language's sample can follow, the phrase goes on, else a new
phrase starts.  The language whose sample parses the text in the fewest phrases per symbol, times the logarithm of the
sample's size, wins: an estimate of cross entropy.

All texts of a batch advance together, a symbol at a time.  Long texts are laid out in segments that advance side by side:
each first starts anew, then those whose start was not where the segment before ended are parsed again from there, until
none changes.  Phrases thus go on across segments, and counts are those of one reader from left to right.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SEGMENT = 128
#: Rounds of parsing segments anew side by side; what is left after them is parsed one by one.
ROUNDS = 8
#: Smaller samples are weighed as if they had so many symbols.
LEAST = 2000


class Automaton:
    """Suffix automaton of a list of symbols, built online: next maps by state, suffix links, lengths."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def phrases(self, symbols: list[int]) -> int:
        """Greedy phrases of longest matches; a symbol that the sample lacks is a phrase by itself."""
        n, s = 0, -1
        for c in symbols:
            t = self.next[s].get(c) if s >= 0 else None
            if t is None:
                n += 1
                t = self.next[0].get(c, -1)
            s = t
        return n


class Table:
    """Transitions of one language's automaton: its most frequent symbols as a dense array, the others as sorted keys.

    Symbol 0 is a gap, 1 a letter that the sample lacks, then its own letters by frequency.  A missing transition starts
    a phrase and goes on from the root.
    """

    DENSE = 32

    def __init__(self, symbols: list[int], letters: int):
        a = Automaton(symbols)
        n = len(a.next)
        self.size = max(len(symbols), LEAST)
        kind = np.uint16 if n + 1 < 1 << 16 else np.uint32
        self.none = int(np.iinfo(kind).max)
        # Last columns: a rare letter, and the filling after a text's end, which changes nothing.
        self.rare, self.pad = min(letters + 2, self.DENSE), min(letters + 2, self.DENSE) + 1
        t = np.full((n + 1, self.pad + 1), self.none, kind)  # state n: after a symbol that the sample lacks, and at the start
        keys, to = [], []
        self.letters = letters + 2
        for s, row in enumerate(a.next):
            for c, q in row.items():
                if c < self.rare:
                    t[s, c] = q
                else:
                    keys.append(s * self.letters + c)
                    to.append(q)
        t[:, self.pad] = np.arange(n + 1)
        o = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.to = np.array(keys, np.int64)[o], np.array(to, np.int64)[o]
        self.root = np.array([a.next[0].get(c, n) for c in range(self.letters)] + [n], np.int32)  # by symbol; the last is the filling
        self.table, self.start, self.states = t.ravel(), n, n

    def columns(self, grid: np.ndarray) -> np.ndarray:
        """The dense column of each symbol (letters: the filling)."""
        col = np.minimum(grid, self.rare)
        col[grid == self.letters] = self.pad
        return col

    def step(self, state: np.ndarray, c: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase starts) for the symbols c."""
        v = self.table.take(state * np.int32(self.pad + 1) + col).astype(np.int32)
        if len(self.keys) and (r := np.flatnonzero(col == self.rare)).size:
            key = state[r].astype(np.int64) * self.letters + c[r]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            v[r[hit]] = self.to[at[hit]]
        new = v == self.none
        n = np.flatnonzero(new)
        v[n] = self.root[c[n]]
        return v, new

    def walk(self, grid: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Phrases that start in each segment grid[:, segment], as one reader would count them who comes from the segment
        before where ``after`` says so.

        All segments are first read side by side as if each were a text's first.  Those whose start was not where the
        one before ended are read again from there, until they fall into step with what was read before.
        """
        size, n = grid.shape
        col = self.columns(grid)
        states, starts = np.empty((size, n), np.int32), np.empty((size, n), np.int8)
        state = np.full(n, self.start, np.int32)
        for j in range(size):
            states[j], starts[j] = self.step(state, grid[j], col[j])
            state = states[j]
        begin, end = np.full(n, self.start, np.int32), state.copy()
        count = starts.sum(0, dtype=np.int64)
        todo = np.flatnonzero(after)
        for _ in range(ROUNDS):
            todo = todo[begin[todo] != end[todo - 1]]
            if not len(todo):
                return count
            state = end[todo - 1].copy()
            begin[todo], was, left = state, end[todo], todo
            for j in range(size):
                state, new = self.step(state, grid[j][left], col[j][left])
                count[left] += new.astype(np.int64) - starts[j, left]
                starts[j, left] = new
                apart = state != states[j, left]
                states[j, left] = state
                left, state = left[apart], state[apart]
                if not len(left):
                    break
            end[left] = state
            todo = todo[was != end[todo]] + 1
            todo = todo[todo < n]
            todo = todo[after[todo]]
        # Texts whose phrases never fall into step, such as one letter over and over: from left to right.
        for r in todo.tolist():
            while r < n and after[r] and begin[r] != end[r - 1]:
                begin[r] = end[r - 1]
                count[r], end[r] = self.follow(grid[:, r], int(begin[r]))
                r += 1
        return count

    def follow(self, row: np.ndarray, state: int) -> tuple[int, int]:
        """The same for one row."""
        n, width = 0, self.pad + 1
        for c in row.tolist():
            if c == self.letters:
                break
            if c < self.rare:
                v = int(self.table[state * width + c])
            else:
                k = int(np.searchsorted(self.keys, state * self.letters + c))
                v = int(self.to[k]) if k < len(self.keys) and self.keys[k] == state * self.letters + c else self.none
            if v == self.none:
                n, v = n + 1, int(self.root[c])
            state = v
        return n, state


class CrossParser:
    """A Table for each language.  What it takes grows with the samples, not with languages times letters."""

    def __init__(self, samples: dict[str, str]):
        self.langs, self.tables = sorted(samples), []
        texts = {k: normal(samples[k]) for k in self.langs}
        union = sorted({c for t in texts.values() for c in set(t) if c != " "})
        self.alphabet = {c: i + 2 for i, c in enumerate(union)}  # 0: between words, 1: any other letter
        self.local = []
        for lang in self.langs:
            often = [c for c, _ in sorted(Counter(c for c in texts[lang] if c != " ").items(), key=lambda x: (-x[1], x[0]))]
            own = {c: i + 2 for i, c in enumerate(often)}
            self.tables.append(Table([0 if c == " " else own[c] for c in texts[lang]], len(own)))
            m = np.ones(len(union) + 2, np.int32)
            m[0] = 0
            for c, i in own.items():
                m[self.alphabet[c]] = i
            self.local.append(m)
        # Matches grow as the logarithm of the sample, so this much of a rate is the sample's size.
        sizes = [t.size for t in self.tables]
        self.weight = np.log(sizes) / np.log(max(sizes)) if sizes else np.ones(0)
        self._classes = None

    def classes(self) -> np.ndarray:
        """The symbol of each code point, in the alphabet of all languages."""
        if self._classes is None:
            t = np.zeros(0x110000, np.int32)
            for p in range(0x110000):
                c = chr(p)
                if c.isalpha():
                    low = c.lower()
                    t[p] = self.alphabet.get(low[0] if low else c, 1)
            self._classes = t
        return self._classes

    def __getstate__(self):
        return self.__dict__ | {"_classes": None}

    def parse(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases[language, text], symbols[text], letters[text])."""
        n, langs = len(texts), len(self.langs)
        points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lens = np.array([len(p) for p in points], np.int64)
        cls = self.classes()[np.concatenate(points)] if n and lens.sum() else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(n), lens)
        letters = np.bincount(doc[cls > 0], minlength=n)
        keep = cls > 0
        if len(cls):
            keep[1:] |= (cls[:-1] > 0) & (doc[1:] == doc[:-1])  # one gap between words
        cls, doc = cls[keep], doc[keep]
        size = np.bincount(doc, minlength=n)
        segments = -(-size // SEGMENT)
        base = np.cumsum(segments) - segments
        owner = np.repeat(np.arange(n), segments)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        row, col = base[doc] + place // SEGMENT, place % SEGMENT
        after = np.r_[False, owner[1:] == owner[:-1]] if len(owner) else np.zeros(0, bool)
        out = np.zeros((langs, n), np.int64)
        for l, t in enumerate(self.tables):
            grid = np.full((SEGMENT, len(owner)), t.letters, np.int32)
            grid[col, row] = self.local[l][cls]
            out[l] = np.bincount(owner, weights=t.walk(grid, after), minlength=n)
        return out, size, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language or und, score): the score compares the best language with the next, 0.5 where they tie."""
        phrases, size, letters = self.parse(texts)
        langs, scores = [], []
        for k in range(len(texts)):
            if not letters[k] or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            rate = phrases[:, k] / size[k] * self.weight
            o = np.argsort(rate, kind="stable")
            langs.append(self.langs[o[0]])
            gap = (rate[o[1]] - rate[o[0]]) * np.sqrt(size[k]) if len(o) > 1 else 40.0
            scores.append(float(1 / (1 + np.exp(-min(gap * 4, 40)))))
        return langs, scores


def normal(text: str) -> str:
    """Lower-case letters, runs of anything else as one space."""
    return re.sub(r"[^\W\d_]+|[\W\d_]+", lambda m: "".join((c.lower() or c)[0] for c in m[0]) if m[0][0].isalpha() else " ", text)


def learn(docs: DataFrame, lang_col: str, text_col: str, chars: int = 24_000, piece: int = 600) -> CrossParser:
    """Samples 2 * chars / piece different texts of each language, or all if it has fewer (those of least hash,
    ``piece`` characters from the middle of each), and builds the automata on the driver from at most ``chars`` symbols
    each.  Copies count once, in the sample and in its rate; no language's sample depends on another's."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(F.col(text_col)) > 0))
    # Some 5 % off: three times as many texts as wanted are expected to pass, so that enough of them always do.
    counts = rows.groupBy(lang_col).agg(F.approx_count_distinct(F.xxhash64(text_col)).alias("count"))
    want = 2 * chars // piece
    at = F.greatest(F.lit(1), F.floor((F.length(text_col) - piece) / 2).cast("int"))
    some = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # Broadcast: one short row for each language, so no text is dealt out before the sample is drawn.
    some = some.join(F.broadcast(counts.select(F.col(lang_col).alias("lang"), "count")), "lang").where((F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)) * F.col("count") < 3 * want)
    some = some.groupBy("lang").agg(F.expr(f"slice(array_sort(collect_set(struct(h, substring(text, greatest(1, cast((length(text) - {piece}) / 2 as int)), {piece}) as t))), 1, {want})").alias("rows"))
    samples = {r.lang: " ".join(x.t for x in r.rows) for r in some.collect()}
    samples = {k: normal(v).strip() for k, v in samples.items()}
    samples = {k: v for k, v in samples.items() if v}
    return CrossParser({k: v[:chars] for k, v in samples.items()})


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score.  ``und`` with score 0 where text is null or has no letter.

    Whole texts are parsed.  Ties go to the first language by name; repeated rows are judged each for itself; an empty
    table gives no rows; other columns don't matter, whatever their names.  The parser travels with the tasks: some 3 MB a
    language at the default sample size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def fn(batches):
        p = shared.value
        for b in batches:
            ids, texts = b.column("id"), b.column("text").to_pylist()
            i = 0
            while i < len(texts):
                j, total = i, 0
                while j < len(texts) and (j == i or total < 400_000):
                    total += len(texts[j] or "")
                    j += 1
                langs, scores = p.predict(texts[i:j])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])
                i = j

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(fn, "id long, lang_pred string, score double")
