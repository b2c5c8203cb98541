"""Passages of held-out items in documents.

A document leaks an item when it holds RUN consecutive words of it, or KEPT of its words in
order within a stretch of STRETCH times its length.  The search is a filter that loses nothing,
followed by an exact check:

1. Gate.  Words are ranked by how many times all documents hold them.  A leak under the second rule keeps all but a quarter of the words, so of the
   (a quarter + m) rarest words at least m stand in one stretch; a leak under the first rule
   holds the rarest word of one RUN-word window beside a neighbour.  Most documents end here.
2. Q-gram lemma.  For a gated pair the shared character q-grams are counted in overlapping
   diagonal bands (diagonal = place in the document less place in the item, in words).  A kept
   word of l characters keeps l - 1 q-grams of its padded form, so a band of a leak holds at
   least the sum over the words that any leak must keep; other bands are dropped.
3. Alignment.  Within the bands that are left, longest common runs and bit-parallel longest
   common subsequences decide by the rule itself.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.frames import frames
from tracelode.llm.words import bare_words
from tracelode.operators.skew import spread

RUN = 12
KEPT = 0.75
STRETCH = 1.5
Q = 4
#: Rare words that must meet beyond the quarter that may be lost.
MEET = 4
#: Items are searched in blocks of so many, which bounds what a task holds of them.
BLOCK = 5000


@dataclass
class Item:
    item_id: object
    words: list[bytes]
    need: int = 0
    stretch: int = 0
    least: int = 0
    meet: int = 0
    grams: dict[bytes, list[int]] = field(default_factory=dict)
    masks: dict[bytes, int] = field(default_factory=dict)
    places: dict[bytes, list[int]] = field(default_factory=dict)


def _grams(word: bytes) -> list[bytes]:
    padded = b" " + word + b" "
    return [padded[i : i + Q] for i in range(len(padded) - Q + 1)]


class Index:
    """Items with their seeds; in_documents tells how often the documents hold each word."""

    def __init__(self, items: list[tuple[object, str | None]], in_documents: dict[bytes, int] | None = None) -> None:
        self.items: list[Item] = []
        self.rare: dict[bytes, list[int]] = defaultdict(list)  # word -> items that count it
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # word -> (item, place)
        held: dict[bytes, int] = defaultdict(int)
        prepared = [(key, bare_words(text) if text else []) for key, text in items]
        for _, words in prepared:
            for w in set(words):
                held[w] += 1
        often = in_documents or {}
        for key, words in prepared:
            if not words:
                continue
            n = len(words)
            item = Item(key, words, need=math.ceil(KEPT * n), stretch=math.floor(STRETCH * n))
            weight = [max(0, len(w) - 1) for w in words]
            item.least = sum(sorted(weight)[: item.need])
            if n >= RUN:
                item.least = min(item.least, min(sum(weight[i : i + RUN]) for i in range(n - RUN + 1)))
            for i, w in enumerate(words):
                item.places.setdefault(w, []).append(i)
                item.masks[w] = item.masks.get(w, 0) | 1 << i
                for g in _grams(w):
                    item.grams.setdefault(g, []).append(i)
            where = len(self.items)
            self.items.append(item)
            rarity = lambda i: (often.get(words[i], 0), held[words[i]], -len(words[i]), words[i], i)
            order = sorted(range(n), key=rarity)
            item.meet = min(MEET, item.need)
            for w in {words[i] for i in order[: n - item.need + item.meet]}:
                self.rare[w].append(where)
            if n >= RUN:
                for place in {min(range(s, s + RUN), key=rarity) for s in range(n - RUN + 1)}:
                    self.anchors[words[place]].append((where, place))
        self.seeds = frozenset(self.rare) | frozenset(self.anchors)

    def gated(self, words: list[bytes]) -> dict[int, list[int]]:
        """Item -> places in the document at which its seeds stand, for pairs that pass the gate."""
        if self.seeds.isdisjoint(words):
            return {}
        met: dict[int, list[int]] = defaultdict(list)
        passed: dict[int, list[int]] = defaultdict(list)
        end = len(words)
        for at, w in enumerate(words):
            if w not in self.seeds:
                continue
            for where in self.rare.get(w, ()):
                met[where].append(at)
            for where, place in self.anchors.get(w, ()):
                own = self.items[where].words
                if (at + 1 < end and place + 1 < len(own) and words[at + 1] == own[place + 1]) or (at and place and words[at - 1] == own[place - 1]):
                    passed[where].append(at)
        for where, places in met.items():
            item = self.items[where]
            k = item.meet
            for i in range(len(places) - k + 1):
                if places[i + k - 1] - places[i] < item.stretch:
                    passed[where] += places[i : i + k]
        return passed

    def leaked(self, text: str) -> list[object]:
        words = bare_words(text)
        return [self.items[where].item_id for where, places in self.gated(words).items() if self._check(self.items[where], words, places)]

    def _check(self, item: Item, words: list[bytes], places: list[int]) -> bool:
        for start, end in _regions(sorted(set(places)), item.stretch, len(words)):
            for a, b in bands(item, words[start:end]):
                if holds_run(item, words, start + a, start + b) or holds_most(item, words, start + a, start + b):
                    return True
        return False


def _regions(places: list[int], around: int, length: int) -> Iterator[tuple[int, int]]:
    """Stretches of the document around the seeds, merged where they meet."""
    start = end = None
    for at in places:
        a, b = max(0, at - around), min(length, at + around + 1)
        if start is None:
            start, end = a, b
        elif a <= end:
            end = max(end, b)
        else:
            yield start, end
            start, end = a, b
    if start is not None:
        yield start, end


def bands(item: Item, words: list[bytes]) -> list[tuple[int, int]]:
    """Word ranges of the diagonal bands that hold enough shared q-grams.

    The diagonals of a leak spread over at most the words of the item (a quarter lost, three
    quarters inserted), so bands twice as wide, a width apart, hold each leak whole in one.
    """
    n = len(item.words)
    count: dict[int, int] = defaultdict(int)
    for at, w in enumerate(words):
        for g in _grams(w):
            for place in item.grams.get(g, ()):
                band = (at - place) // n
                count[band] += 1
                count[band - 1] += 1
    kept = sorted(band for band, k in count.items() if k >= item.least)
    return list(_regions_of([(band * n, (band + 2) * n + n) for band in kept], len(words)))


def _regions_of(ranges: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int]]:
    start = end = None
    for a, b in ranges:
        a, b = max(0, a), min(length, b)
        if start is None:
            start, end = a, b
        elif a <= end:
            end = max(end, b)
        else:
            yield start, end
            start, end = a, b
    if start is not None:
        yield start, end


def holds_run(item: Item, words: list[bytes], start: int, end: int) -> bool:
    """RUN consecutive words of the item in words[start:end]."""
    before: dict[int, int] = {}
    for at in range(start, end):
        now = {}
        for place in item.places.get(words[at], ()):
            run = before.get(place - 1, 0) + 1
            if run >= RUN:
                return True
            now[place] = run
        before = now
    return False


def holds_most(item: Item, words: list[bytes], start: int, end: int) -> bool:
    """KEPT of the item's words in order within a stretch; a stretch may start at its first
    matching word."""
    n, need = len(item.words), item.need
    full = (1 << n) - 1
    known = [item.masks.get(w, 0) for w in words[start:end]]
    hits = [1 if m else 0 for m in known]
    ahead = sum(hits[: item.stretch])
    for s in range(len(known)):
        if hits[s] and ahead >= need:
            v = full
            for m in known[s : s + item.stretch]:
                if m:
                    u = v & m
                    v = ((v + u) | (v - u)) & full
            if n - v.bit_count() >= need:
                return True
        ahead -= hits[s]
        if s + item.stretch < len(known):
            ahead += hits[s + item.stretch]
    return False


def word_counts(rows: DataFrame, block: list[tuple[object, str]]) -> dict[bytes, int]:
    """How often all documents hold each word of a block of items; as large as its vocabulary."""
    vocabulary = frozenset(w for _, text in block for w in bare_words(text))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch["__text"]:
                if value:
                    seen.update(filter(vocabulary.__contains__, bare_words(value)))
        yield from frames(list(seen.items()), ["word", "k"])

    counted = rows.select("__text").mapInPandas(count, "word binary, k long").groupBy("word").agg(F.sum("k").alias("k"))
    return {bytes(r["word"]): r["k"] for r in counted.collect()}


def find_leaks(documents: DataFrame, doc_id: str, text: Column, items: DataFrame, item_id: str, item_text: Column) -> DataFrame:
    """(doc_id, item_id): distinct pairs of document and leaked item.

    documents are read once for each block of items and never shuffled for the search.  Items
    without words and null or empty documents are in no pair; repeated rows give their pairs
    once.  The items of a block (at most BLOCK) go to every task.
    """
    held = items.select(F.col(item_id).cast("string").alias(item_id), item_text.alias("__text")).where(F.col("__text").isNotNull()).distinct()
    blocks = max(1, math.ceil(held.count() / BLOCK))
    # Keys travel as text: pandas would turn integers beside a null into floats.
    rows = spread(documents.select(F.col(doc_id).cast("string").alias(doc_id), text.alias("__text")).where(F.col("__text").isNotNull()), doc_id)
    found = []
    for k in range(blocks):
        block = [(r[0], r[1]) for r in held.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == k).collect()]
        often = word_counts(rows, block)

        def search(batches: Iterator[pd.DataFrame], block: list = block, often: dict = often) -> Iterator[pd.DataFrame]:
            index = Index(block, often)
            for batch in batches:
                out = [(key, item) for key, value in zip(batch[doc_id], batch["__text"]) if value for item in index.leaked(value)]
                yield from frames(out, [doc_id, item_id])

        found.append(rows.mapInPandas(search, f"`{doc_id}` string, `{item_id}` string"))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    return pairs.select(F.col(doc_id).cast(documents.schema[doc_id].dataType).alias(doc_id), F.col(item_id).cast(items.schema[item_id].dataType).alias(item_id))
