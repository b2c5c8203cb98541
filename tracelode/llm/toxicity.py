"""Abusive, hateful and sexual content, by a lexicon that forgives spelling.

A token is brought to bare form (look-alikes, leet digits, separators, stretched letters, stars).
What is neither a listed nor an ordinary word is looked up within an edit distance that grows
with its length, swapped letters counting as one edit: a Levenshtein automaton is walked together
with the trie of the whole lexicon.  Ordinary words are the whole words in the vocabularies of
public tokenizers, so that "pitch" is no misspelling.  Each hit is then weighed in a window of its
own sentence: who is addressed, whether the speaker means themself, whether the remark is only
reported; a misspelling counts only where somebody is addressed or other hits stand beside it.
"""

from __future__ import annotations

import base64
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm import lexicon
from tracelode.llm.words import plain, without_markup
from tracelode.operators.skew import spread

#: Words on each side of a hit that belong to its window.
WINDOW = 14
#: A document is abusive from this score on.
THRESHOLD = 1.0
#: Weight of a sentence that only calls a name.
NAMING = 0.8
#: Edits that a token of so many letters may differ by; shorter ones must be exact.
EDITS = [(4, 1), (8, 2)]
#: Folder of the public tokenizers, whose whole words count as ordinary.
VOCABULARIES = os.environ.get("TRACELODE_VOCABULARIES", "/opt/tokenizers")
VOCABULARY_FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
CACHE = 400_000

_LEET = [str.maketrans("430157$@!8", "aeoistsaib"), str.maketrans("43015$@!7", "aeolssait")]
_INNER = re.compile(r"[.\-_'’·~^|+]+")
_EDGE = "\"'“”„«»‘’`()[]{}<>,.;:!?/\\|#%&=+~^_-"
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_] ){3,}[^\W_](?![^\W_])")
_TOKEN = re.compile(r"\S+")


@lru_cache(maxsize=1)
def ordinary_words(folder: str = VOCABULARIES) -> frozenset[str]:
    """Words of three letters and more that tokenizers hold as one token behind a blank."""
    words = set()
    for file in VOCABULARY_FILES:
        with open(f"{folder}/{file}", "rb") as lines:
            for line in lines:
                token = base64.b64decode(line.split()[0])
                if token[:1] == b" " and len(token) > 3:
                    try:
                        words.add(plain(token[1:].decode()))
                    except UnicodeDecodeError:
                        continue
    return frozenset(w for w in words if w.isalpha())


def edits_for(length: int) -> int:
    """The edits that are forgiven a word of so many letters."""
    return max((most for least, most in EDITS if length >= least), default=0)


def letters_of(word: str) -> int:
    """The set of letters of a word, as the bits of a number."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 61
    return bits


class Trie:
    """Words with their class; near() walks it as the intersection with a Levenshtein automaton."""

    def __init__(self, words: dict[str, str]) -> None:
        self.words = words
        self.root: dict = {}
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
            self.by_length[len(w)].append(w)
        self.letters = {size: sorted({letters_of(w) for w in held}) for size, held in self.by_length.items()}

    def possible(self, token: str, most: int) -> bool:
        """False where no word can be within most edits: an edit brings at most one letter that
        the token lacks, and takes at most one that it has."""
        own = letters_of(token)
        for size in range(len(token) - most, len(token) + most + 1):
            for w in self.letters.get(size, ()):
                if (own & ~w).bit_count() <= most and (w & ~own).bit_count() <= most:
                    return True
        return False

    def near(self, token: str, most: int = 1, swaps: bool = False) -> str | None:
        """The nearest word within most edits, of equal ones the first in the alphabet.

        swaps: two neighbouring letters in the wrong order are one edit.  A state of the
        automaton is one number for each count of edits; its bit i says that the first i letters
        of the token are read.
        """
        if not self.possible(token, most):
            return None
        of: dict[str, int] = {}
        for i, c in enumerate(token):
            of[c] = of.get(c, 0) | 1 << i
        last = 1 << len(token)
        full = (last << 1) - 1
        best: tuple[int, str] | None = None
        start = tuple((1 << d + 1) - 1 & full for d in range(most + 1))
        stack = [(self.root, start, (0,) * (most + 1), "")]
        while stack:
            node, state, before, came = stack.pop()
            if "" in node:
                for d, bits in enumerate(state):
                    if bits & last:
                        if best is None or (d, node[""]) < best:
                            best = (d, node[""])
                        break
            for c, child in node.items():
                if not c:
                    continue
                here = of.get(c, 0)
                now = [(state[0] & here) << 1]
                for d in range(1, most + 1):
                    bits = (state[d] & here) << 1 | state[d - 1] | state[d - 1] << 1 | now[d - 1] << 1
                    if swaps and came:
                        bits |= (before[d - 1] & here & of.get(came, 0) >> 1) << 2
                    now.append(bits & full)
                if now[-1]:
                    stack.append((child, tuple(now), state, c))
        return best[1] if best else None

    def starred(self, token: str) -> str | None:
        """The word of which token shows some letters and hides the others by stars."""
        for w in self.by_length.get(len(token), ()):
            if all(t in ("*", c) for t, c in zip(token, w)):
                return w
        return None


def _phrases(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().split("\n")]


@dataclass
class Hit:
    at: int
    kind: str
    weight: float
    misspelt: bool = False


class Scorer:
    """Scores texts; keeps what it has learnt of single tokens."""

    def __init__(self, vocabularies: str = VOCABULARIES, forgiving: bool = True) -> None:
        self.forgiving = forgiving
        words: dict[str, str] = {}
        for kind in ("vulgar", "intimate", "sexual", "insult"):
            for w in getattr(lexicon, kind.upper()).split():
                words[w] = kind
        # Plurals of insults.
        for w in lexicon.INSULT.split():
            words.setdefault(w + "s", "insult")
        self.trie = Trie(words)
        self.you = frozenset(lexicon.YOU.split())
        self.things = frozenset(lexicon.THINGS.split())
        self.aimed = frozenset(lexicon.AIMED.split())
        self.groups = frozenset(lexicon.GROUPS.split())
        self.before = frozenset(lexicon.REPORT_BEFORE.split())
        self.after = frozenset(lexicon.REPORT_AFTER.split())
        self.own = [p.split() for p in lexicon.SELF]
        self.technical = {tuple(p.split()) for p in lexicon.TECHNICAL}
        self.phrases: dict[str, list[tuple[str, list[str]]]] = defaultdict(list)
        classes = {name: frozenset(words.split()) for name, words in lexicon.CLASSES.items()}
        for kind in ("threat", "demean", "degrade"):
            for p in _phrases(getattr(lexicon, kind.upper())):
                steps = [len(x) if set(x) == {"_"} else classes.get(x, frozenset([x])) for x in p]
                for first in steps[0]:
                    self.phrases[first].append((kind, steps))
        self.beside = frozenset(lexicon.GROUP_BESIDE.split())
        self.people = frozenset(lexicon.PEOPLE.split())
        self.ordinary = ordinary_words(vocabularies)
        self.known: dict[str, tuple[str, str | None]] = {}
        self.misspelt: set[str] = set()

    def token(self, raw: str) -> tuple[str, str | None]:
        """(bare form, class or None) of a raw lower-case token."""
        got = self.known.get(raw)
        if got is None:
            if len(self.known) > CACHE:
                self.known.clear()
            got = self.known[raw] = self._token(raw)
        return got

    def _token(self, raw: str) -> tuple[str, str | None]:
        words = self.trie.words
        core = raw.strip(_EDGE)
        bare = core.strip("*")
        if bare in words:
            return bare, words[bare]
        if "*" in bare and len(bare) >= 4 and re.fullmatch(r"[^\W\d_]+\*{2,}[^\W\d_]+", bare):
            if w := self.trie.starred(bare):
                return w, words[w]
        candidates = [_INNER.sub("", bare)]
        if any(c in "0134578$@!" for c in bare) and any(c.isalpha() for c in bare):
            # A lone trailing mark is punctuation, not a letter; both readings are tried.
            for table in _LEET:
                for form in (core, bare.rstrip("!")):
                    candidates.append(_INNER.sub("", form.translate(table)))
        for c in list(candidates):
            if _RUN.search(c):
                candidates += [_RUN.sub(r"\1", c), _RUN.sub(r"\1\1", c)]
        for c in candidates:
            if c in words:
                return c, words[c]
        # Bare words and disguised ones; ordinary words are no misspellings of listed ones.
        if self.forgiving and "_" not in raw and not any(self.is_ordinary(c) for c in candidates):
            # Numbers read as letters are no misspellings: letters must prevail.
            lettered = 2 * sum(c.isalpha() for c in bare) > len(bare)
            for c in candidates if lettered else candidates[:1]:
                if c.isalpha() and (most := edits_for(len(c))) and (w := self.trie.near(c, most, swaps=True)) and edits_for(len(w)) >= 1:
                    self.misspelt.add(c)
                    return c, words[w]
        return candidates[0], None

    def is_ordinary(self, token: str) -> bool:
        """The token or what is left without a common ending is an ordinary word."""
        return token in self.ordinary or any(token.endswith(e) and token[: -len(e)] in self.ordinary for e in ("s", "es", "ed", "ing", "ly"))

    def sentences(self, text: str) -> Iterator[list[tuple[str, str | None, bool]]]:
        """Lists of (bare token, class, inside quotation marks), one for each sentence, and an
        empty one behind each line."""
        for line in plain(without_markup(text)).replace("’", "'").replace("'", " ").split("\n"):
            hidden = {}
            if _SPACED.search(line):
                line = _SPACED.sub(lambda m: self._joined(m.group(), hidden), line)
            out: list[tuple[str, str | None, bool]] = []
            quoted = False
            for raw in line.split():
                opens = raw[0] in "\"“„«"
                if opens:
                    quoted = True
                bare, kind = self.token(raw)
                if bare and "-" in raw and kind is None:
                    parts = [self.token(x) for x in raw.split("-") if x]
                    out += [(b, k, quoted) for b, k in parts if b]
                elif bare:
                    out.append((bare, kind, quoted))
                tail = raw.rstrip(",;:.!?)")
                if quoted and tail and tail[-1] in "\"”“»" and (len(tail) > 1 or not opens):
                    quoted = False
                if raw[-1] in ".!?" and out:
                    yield out
                    out, quoted = [], False
            if out:
                yield out
            yield []

    def _joined(self, run: str, hidden: dict) -> str:
        """Letters written apart, joined where they hold a listed word."""
        letters = run.replace(" ", "")
        for form in (letters, letters.translate(_LEET[0])):
            for size in range(len(form), 3, -1):
                for i in range(len(form) - size + 1):
                    if form[i : i + size] in self.trie.words:
                        rest = " ".join(form[:i]), form[i : i + size], " ".join(form[i + size :])
                        return " ".join(x for x in rest if x)
        return run

    def hits(self, sentence: list[tuple[str, str | None, bool]]) -> list[Hit]:
        bare = [t[0] for t in sentence]
        found = []
        for i, (w, kind, _) in enumerate(sentence):
            if kind and not any(tuple(bare[i : i + len(p)]) == p for p in self.technical if p[0] == w):
                found.append(Hit(i, kind, 0.0, w in self.misspelt))
            for name, p in self.phrases.get(w, ()):
                if self._phrase(bare, i, p):
                    found.append(Hit(i, name, 0.0))
            if w in self.groups or (w in self.beside and not self.people.isdisjoint(bare[max(0, i - 3) : i + 3])):
                found.append(Hit(i, "group", 0.0))
        return found

    @staticmethod
    def _phrase(bare: list[str], at: int, steps: list) -> bool:
        i, slack = at, 0
        for p in steps:
            if isinstance(p, int):
                slack = p
                continue
            end = min(len(bare), i + slack + 1)
            j = next((k for k in range(i, end) if bare[k] in p), None)
            if j is None:
                return False
            i, slack = j + 1, 0
        return True

    def reported(self, sentence: list, at: int) -> bool:
        """The remark is told of: in quotation marks or after a word of saying, and what became of
        it follows."""
        bare = [t[0] for t in sentence]
        said = sentence[at][2] or any(w in self.before for w in bare[max(0, at - 6) : at])
        return said and any(w in self.after for w in bare[at + 1 : at + 1 + WINDOW])

    def own_person(self, bare: list[str], at: int) -> bool:
        ahead = bare[max(0, at - 5) : at]
        return any(ahead[i : i + len(p)] == p for p in self.own for i in range(len(ahead)))

    def weigh(self, sentence: list) -> float:
        """The score of one sentence."""
        found = self.hits(sentence)
        if not found:
            return 0.0
        bare = [t[0] for t in sentence]
        for h in found:
            if self.reported(sentence, h.at):
                continue
            near = bare[max(0, h.at - WINDOW) : h.at + WINDOW + 1]
            addressed = any(w in self.you for w in near)
            others = {o.kind for o in found if o is not h and abs(o.at - h.at) <= WINDOW}
            if h.misspelt and not (addressed or any(w in self.aimed for w in bare[max(0, h.at - 3) : h.at]) or others - {"group", "degrade", "vulgar", "intimate"}):
                continue
            if h.kind in ("threat", "demean"):
                h.weight = 1.0
            elif h.kind == "degrade":
                h.weight = 1.0 if "group" in others else 0.4
            elif h.kind == "sexual":
                h.weight = 1.0
            elif h.kind == "intimate":
                h.weight = 0.6 if addressed else 0.0
                if addressed and others & {"sexual", "intimate", "insult", "demean"}:
                    h.weight = 1.0
            elif h.kind == "insult":
                if self.own_person(bare, h.at):
                    continue
                aimed = bare[h.at] not in self.things and any(w in self.aimed for w in bare[max(0, h.at - 3) : h.at])
                again = any(o.kind == "insult" and o is not h for o in found)
                h.weight = 1.0 if addressed or aimed or again or others & {"demean", "threat", "degrade"} else 0.5
                if len(sentence) <= 3:
                    h.weight = max(h.weight, NAMING)
            elif h.kind == "vulgar":
                h.weight = 0.4 if addressed else 0.2
        return sum(h.weight for h in found)

    def score(self, text: str) -> tuple[float, int]:
        """(score, sentences that count): the highest sentence; two neighbours on a line that
        only call names ("Idiot. Total filth.") count as one remark."""
        weights, before = [], 0.0
        for sentence in self.sentences(text):
            w = self.weigh(sentence) if sentence else 0.0
            if NAMING <= w < THRESHOLD and NAMING <= before < THRESHOLD:
                weights.append(w + before)
            elif w > 0:
                weights.append(w)
            before = w
        return (max(weights), sum(w >= THRESHOLD for w in weights)) if weights else (0.0, 0)


def score_texts(documents: DataFrame, doc_id: str, text: Column, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, score, n_abusive) of every row; null and empty texts score 0.

    A narrow step: rows keep their partition, whole texts are read, nothing is shuffled.
    """
    kept = keep or []
    every = [doc_id, *kept]
    kinds = ", ".join(f"`{c}` string" for c in every)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer()
        for batch in batches:
            got = [scorer.score(t) if t else (0.0, 0) for t in batch["__text"]]
            yield batch[[doc_id, *kept]].assign(score=[g[0] for g in got], n_abusive=[g[1] for g in got])

    # Columns travel as text: pandas would turn integers beside a null into floats.
    rows = spread(documents.select(*[F.col(c).cast("string").alias(c) for c in every], text.alias("__text")), doc_id)
    scored = rows.mapInPandas(run, f"{kinds}, score double, n_abusive int")
    return scored.select(*[F.col(c).cast(documents.schema[c].dataType).alias(c) for c in every], "score", "n_abusive")
