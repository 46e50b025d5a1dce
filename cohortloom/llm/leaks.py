"""Evaluation texts leaking into training text: pigeonhole edit matching with Myers' bit-parallel distance.

The error budget of an item of n words is n - ceil(held * n); no piece longer than a word is sure to survive it, so the pieces
are single words weighted by rarity, and every filter keeps each place within the budget. Of the item's rarest ``budget + r``
words ``r`` are held (the pigeonhole principle), in a stretch of ``n + budget`` words of the document; so are ``n - budget`` of
all its words. Stretches with fewer are left: first by counts of hits, for all items at once, then with a word counting as
often as in the item at most. The others are verified: Myers' bit-parallel algorithm gives the least number of words to
replace, leave out or insert that turns the item into some span of the stretch; left-out words are those not held.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most items, and about the most characters of them, that are sent to every executor at once; more go in further passes.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 20_000_000
#: Words of a document that are counted at once.
CHUNK = 50_000

#: One in so many of the words an item must hold is asked for among its rarest, before all its words are counted.
RARE_PART = 2

_MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-zA-Z]{2,8};|&#\d{1,6};")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words in lower case, without mark-up, punctuation and underscores."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower())


def myers(pattern_masks: dict[str, int], m: int, text: list[str]) -> tuple[int, int]:
    """Least edit distance (in words) of a pattern of m words to any span of ``text``, and the end of the first such span.

    ``pattern_masks``: for each word, the bits of its places in the pattern. Any m: Python's integers are as wide as needed."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, -1
    get = pattern_masks.get
    for at, word in enumerate(text):
        eq = get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, at
    return best, end


class _Matcher:
    """The items' rare words and masks; built once per Python worker task from the items' words. ``seen``: how often words occur
    in some documents; it decides which words count as rare, so the speed but not the result."""

    def __init__(self, items: list[tuple[int, list[str]]], held: float, seen: Counter) -> None:
        self.words = dict(items)
        self.masks: dict[int, dict[str, int]] = {}
        self.often: dict[int, Counter] = {}
        self.need: dict[int, int] = {}
        self.few: dict[int, Counter] = {}
        self.least: dict[int, int] = {}
        for i, w in items:
            masks: dict[str, int] = defaultdict(int)
            for j, x in enumerate(w):
                masks[x] |= 1 << j
            self.masks[i], self.often[i] = dict(masks), Counter(w)
            self.need[i] = max(1, math.ceil(held * len(w) - 1e-9))
            self.least[i] = 1 + self.need[i] // RARE_PART
            by_rarity = sorted(w, key=lambda x: (seen[x], x))
            self.few[i] = Counter(by_rarity[: len(w) - self.need[i] + self.least[i]])
        self.items = np.array([i for i, _ in items], dtype=object)
        self.code = {x: at for at, x in enumerate(sorted({x for _, w in items for x in w}))}
        # word x item: does the item have it, is it one of its rare words; the last row stands for words of no item
        self.every, self.rare = (np.zeros((len(self.code) + 1, len(items)), np.uint8) for _ in range(2))
        for at, i in enumerate(self.items):
            self.every[[self.code[x] for x in self.often[i]], at] = 1
            self.rare[[self.code[x] for x in self.few[i]], at] = 1
        self.least_every = np.array([self.need[i] - (len(w) - len(self.often[i])) for i, w in items])
        self.least_rare = np.array([self.least[i] - (self.few[i].total() - len(self.few[i])) for i in self.items])
        self.hits = np.array([[self.need[i], self.least[i], 2 * len(w) - self.need[i]] for i, w in items]).reshape(-1, 3).T  # of all words, of rare ones, within

    def _likely(self, code: np.ndarray) -> np.ndarray:
        """Items that have enough hits in some stretch of the document, each hit counting: more than those that are held. All
        items' stretches are as wide as the widest one's."""
        seen = np.zeros(len(self.code) + 1, bool)
        seen[code] = True
        here = np.flatnonzero(seen)
        some = np.flatnonzero((self.rare[here].sum(0, dtype=np.int32) >= self.least_rare) & (self.every[here].sum(0, dtype=np.int32) >= self.least_every))
        if not len(some):
            return some
        for table, at in ((self.every, 0), (self.rare, 1)):
            need, wide = self.hits[at, some], int(self.hits[2, some].max())
            enough = np.zeros(len(some), bool)
            for lo in range(0, len(code), CHUNK):
                total = np.cumsum(np.take(table, code[lo : lo + CHUNK + wide], axis=0)[:, some], axis=0, dtype=np.int32)
                total = np.concatenate([np.zeros((1, len(some)), np.int32), total])
                enough |= (total[wide:] - total[:-wide] if len(total) > wide else total[-1:]).max(0) >= need
            some = some[enough]
            if not len(some):
                break
        return some

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, words held, first word, last word) for each item that the text holds; the best place of each."""
        if not len(self.items) or not text:
            return []
        w = words_of(text)
        if not w:
            return []
        none = len(self.code)
        get = self.code.get
        code = np.array([get(x, none) for x in w])
        found: list[tuple[int, int, int, int]] = []
        for a in self._likely(code):
            i = self.items[a]
            often, need, n = self.often[i], self.need[i], len(self.words[i])
            few, least, width = self.few[i], self.least[i], 2 * n - need
            hits = lambda table, a=a: [(p, w[p]) for p in np.flatnonzero(table[code, a]).tolist()]
            if not self._stretches(hits(self.rare), few, least, width):
                continue
            for lo, hi in self._stretches(hits(self.every), often, need, width):
                d, end = myers(self.masks[i], n, w[lo:hi])
                if n - d >= need:
                    found.append((i, n - d, max(0, lo + end - (n - d) + 1), lo + end))
        return self._best(found, w)

    @staticmethod
    def _stretches(hits: list[tuple[int, str]], often: Counter, need: int, width: int) -> list[tuple[int, int]]:
        """Stretches of the document covering all windows of ``width`` words that hold ``need`` of the item's words."""
        spans: list[tuple[int, int]] = []
        count: dict[str, int] = dict.fromkeys(often, 0)
        got = first = 0
        for p, x in hits:
            count[x] += 1
            got += count[x] <= often[x]
            while hits[first][0] <= p - width:
                y = hits[first][1]
                got -= count[y] <= often[y]
                count[y] -= 1
                first += 1
            if got >= need:
                lo = hits[first][0]
                if spans and lo < spans[-1][1]:
                    spans[-1] = (spans[-1][0], p + 1)
                else:
                    spans.append((lo, p + 1))
        return spans

    def _best(self, found: list[tuple[int, int, int, int]], w: list[str]) -> list[tuple[int, int, int, int]]:
        """The best place of each item, without places that are another item's text.

        Items built on one template hold much of each other's words. A place isn't reported for an item if it holds
        another item better by a sixth of its words, less than 80 % of this one, and not half of it with single words
        replaced or left out (as the problem is stated): if the words lost come in runs."""
        share = lambda x: x[1] / len(self.words[x[0]])
        best: dict[int, tuple[int, int, int, int]] = {}
        for x in found:
            rivals = (y for y in found if y[0] != x[0] and min(x[3], y[3]) - max(x[2], y[2]) + 1 >= 0.6 * (x[3] - x[2] + 1) and share(y) > share(x) + 1 / 6)
            if share(x) < 0.8 and any(True for _ in rivals):
                p = self.words[x[0]]
                if held_with_single_gaps(p, w[max(0, x[2] - len(p)) : x[3] + 1]) < self.need[x[0]]:
                    continue
            if x[0] not in best or x[1] > best[x[0]][1]:
                best[x[0]] = x
        return list(best.values())


def held_with_single_gaps(p: list[str], t: list[str]) -> int:
    """Most words of ``p`` held, in order, in a part of it of which no two neighbouring words are lost, by an alignment of least
    edits to some span of ``t``."""
    rows = [np.zeros(len(t) + 1, int)]
    eq = {x: np.array([y != x for y in t], dtype=int) for x in set(p)}
    steps = np.arange(len(t) + 1)
    for i, x in enumerate(p, 1):
        row = np.concatenate([[i], np.minimum(rows[-1][:-1] + eq[x], rows[-1][1:] + 1)])
        rows.append(np.minimum.accumulate(row - steps) + steps)  # words put in
    i, j, held = len(p), int(rows[-1].argmin()), [False] * len(p)
    while i:
        if j and rows[i][j] == rows[i - 1][j - 1] + (p[i - 1] != t[j - 1]):
            held[i - 1] = p[i - 1] == t[j - 1]
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    most = run = 0
    for a, b in zip([True, *held], held, strict=False):
        run = run + b if a or b else 0
        most = max(most, run)
    return most


def find_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, *, held: float = 0.5) -> DataFrame:
    """Documents that hold at least ``held`` of the words of a test item in order and in one place: ``item``, ``doc``,
    ``held_words``, ``item_words``. One row per pair, the best place.

    Case, punctuation, mark-up and spacing don't matter; words replaced, left out or put in count against the words held.
    The corpus is never shuffled; the words of the items are what travels, ``BLOCK_ITEMS`` and about ``BLOCK_CHARS`` at a time: the
    corpus is read once for each such block of items. Items are compared with rivals of their block (see
    ``_Matcher._best``). Null and empty texts and passages match nothing; whole texts are searched, however long; repeated
    rows come out as often as they are."""
    size = items.selectExpr("count(*) n", f"coalesce(sum(length({passage})), 0) c").first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["c"] // BLOCK_CHARS))
    own = items.select(F.col(item).alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null").distinct()
    kinds = dict(docs.dtypes) | {f"item {k}": v for k, v in items.dtypes}

    def passed(known: list[tuple]) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher: _Matcher | None = None
            for b in batches:
                if matcher is None:
                    matcher = _Matcher(known, held, Counter(x for t in b.iloc[:200, 1] if isinstance(t, str) for x in set(words_of(t))))
                rows = [(i, d, n, len(matcher.words[i])) for d, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) if isinstance(t, str) for i, n, _, _ in matcher.match(t)]
                yield pd.DataFrame(rows, columns=["item", "doc", "held_words", "item_words"])

        return docs.select(doc, text).where(f"length({text}) > 0").mapInPandas(search, f"item {kinds[f'item {item}']}, doc {kinds[doc]}, held_words int, item_words int")

    out = None
    for k in range(blocks):  # a block of the test items comes to the driver, never the corpus
        known = [(r["i"], w) for r in own.where(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == k).orderBy("i", "p").collect() if (w := words_of(r["p"]))]
        got = passed(known)
        out = got if out is None else out.unionByName(got)
    return out
