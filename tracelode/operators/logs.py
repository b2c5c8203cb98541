"""Log text of unknown programs to entries, by templates mined from the texts.

1. Lines are masked (digits, hex values, long identifiers) and counted, so that only distinct
   ones are mined.  Lines that cannot start an entry, as they hold no time, no level and no tag,
   are dropped before anything is shuffled.
2. Each line becomes typed tokens (time, level, name, number, hex, path, punctuation); plain words
   keep their text.  Lines of the same skeleton (punctuation and times in order) are clustered by
   longest common subsequence: what all lines of a cluster share is constant, what differs is a
   slot, or a gap where even the number of tokens differs.
3. The templates of all partitions are merged the same way, by skeleton, over all tasks.
4. classify() reads the slots of a merged template by type and surroundings: time, level and
   component, and where the header ends.  A name without delimiters is a component only where the
   template shows it as a slot.  A tag without time or level starts an entry only where its
   messages are of templates that other entries have.
5. The header shapes are compiled to one pattern each and every row is parsed with them.

A row's text is parsed within the row, so no row order or group is needed.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.frames import frames
from tracelode.session import cut_lineage

# Level words and letters as programs write them, by the level they mean.
LEVELS = {
    "DEBUG": ["debug", "dbg", "trace", "d"],
    "INFO": ["info", "information", "notice", "note", "i", "n"],
    "WARN": ["warn", "warning", "w"],
    "ERROR": ["error", "err", "e"],
    "FATAL": ["fatal", "fatal error", "critical", "crit", "alert", "emerg", "panic", "f", "c"],
}
LEVEL_OF = {word: level for level, words in LEVELS.items() for word in words}
_WORDS = "|".join(sorted((w for w in LEVEL_OF if len(w) > 2), key=len, reverse=True))

#: Time grammars; each is a token type of its own.
TIMES = {
    "T_iso": r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?",
    "T_month": r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:\d\d:\d\d(?:\.\d+)?",
    "T_slash": r"(?:\d{4}/)?\d\d/\d\d(?:/\d{2,4})? \d\d:\d\d:\d\d(?:[.,]\d+)?",
    "T_md": r"(?<=^[A-Z])\d{4} \d\d:\d\d:\d\d\.\d+",
    "T_clock": r"\d\d:\d\d:\d\d(?:[.,]\d+)?",
    "T_count": r"\d+\.\d{6}\b|\d{3,}\.\d{3,9}\b",
}
TOKENS = TIMES | {
    "H": r"0x[0-9A-Fa-f]+\b",
    "P": r"(?:[A-Za-z]:)?[\w.+-]*[/\\][\w./\\+-]*\.\w+|[\w+-]+\.(?:c|cc|cpp|cxx|h|hpp|py|java|go|rs|asn1?)\b",
    "L": rf"(?i:\b(?:{_WORDS})\b)",
    "1": r"(?<![\w.])[A-Z](?![A-Za-z_.])(?=[\] ]|\d{4} )",
    "C": r"[A-Za-z_][\w.]*(?:-[A-Za-z_][\w.]*)*",
    "N": r"\d+",
    "^": r"[^\w\s]",
}
_TOKEN = re.compile("|".join(f"(?P<{k if k[0].isalpha() else {'1': 'letter', '^': 'mark'}[k]}>{v})" for k, v in TOKENS.items()))
_NAMES = {"letter": "1", "mark": "^"}
_COLOUR = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]")
#: Least share of the longer sequence that two templates have in common.
COMMON = 0.6
#: Distinct values from which on a name without delimiters is a slot of its own.
SLOT_VALUES = 3
#: Values kept of a slot; more are only known to be several.
KEPT_VALUES = 8
# Names of fields, by what they hold.
MESSAGE_KEYS = {"msg", "message", "text", "event"}
HOST_KEYS = {"host", "hostname", "node", "machine", "ip", "addr", "address", "user", "pid", "tid", "thread", "id", "env", "region", "dc"}
COMPONENT_KEYS = {"component", "comp", "module", "mod", "logger", "name", "program", "app", "service", "subsystem", "unit", "task", "caller", "file", "source"}

_HEX = re.compile(r"0x[0-9A-Fa-f]+")
_LONG_NAME = re.compile(r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+){2,}")
_DIGITS = str.maketrans("123456789", "000000000")
_LEVEL_WORD = re.compile(rf"\b(?:{_WORDS})\b", re.I)


@dataclass
class Token:
    kind: str
    text: str
    spaced: bool | None
    values: frozenset = frozenset()

    @property
    def slot(self) -> bool:
        """Whether the place is known to take several values."""
        return len(self.values) > 1

    @property
    def typed(self) -> bool:
        """A name by its form: with a dot, an underscore or a digit."""
        return self.kind == "C" and (not self.text or any(c in "._" or c.isdigit() for c in self.text))

    @property
    def symbol(self) -> str:
        """What must be equal for two tokens to be in common."""
        return self.text if self.kind == "C" and not self.typed and not self.slot else self.kind


def masked(line: str) -> str:
    """The line with its digits, hex values and long identifiers made alike."""
    if "0x" in line:
        line = _HEX.sub("0x0", line)
    line = line.translate(_DIGITS)
    return _LONG_NAME.sub("a_a_a", line) if line.count("_") > 1 else line


def tokens(line: str) -> list[Token]:
    """The typed tokens of a line without colours."""
    out, end = [], 0
    for m in _TOKEN.finditer(line):
        kind = _NAMES.get(m.lastgroup, m.lastgroup)
        text = m.group()
        out.append(Token(text if kind == "^" else kind, text, m.start() > end, frozenset([text]) if kind == "C" else frozenset()))
        end = m.end()
    return out


@dataclass
class Header:
    """Places of the slots of a header, and how many tokens it takes."""

    ts: int = -1
    level: int = -1
    component: int = -1
    length: int = 0
    keys: set = field(default_factory=set)
    tag: bool = False


def classify(seq: list[Token]) -> Header | None:
    """Slots of a template, or of a single line, by type and surroundings; None where it starts
    no entry.

    A header is a run of delimited fields: times, levels, numbers and names that stand in
    brackets or quotes, behind the name of a field or before a mark.  It ends before the first
    word that is none of these.
    """
    kind = lambda i: seq[i].kind if 0 <= i < len(seq) else ""
    spaced = lambda i: bool(seq[i].spaced) if 0 <= i < len(seq) else True
    head = Header()
    named = False  # the component was named by its field
    i = 0
    while i < len(seq):
        k, before, after = kind(i), kind(i - 1), kind(i + 1)
        quoted = before == '"' and after == '"'
        if k.startswith("T_") and head.ts < 0:
            head.ts = i
        elif k in "[{(\"|-:,]=}" and len(k) == 1:
            if k in "|-,}" and head.ts < 0 and head.level < 0:
                break
        elif k in ("C", "L") and before != "=" and (after == "=" or (quoted and kind(i + 2) == ":")):
            # The name of a field; what is told in words (msg="...") ends the header.
            key = seq[i].text.lower()
            if key in MESSAGE_KEYS:
                break
            head.keys.add(i)
            value = i + (2 if after == "=" else 4)
            if kind(value) in ("C", "P") and key in HOST_KEYS:
                i = value
            elif kind(value) in ("C", "P") and (head.component < 0 or (key in COMPONENT_KEYS and not named)):
                head.component, named = value, key in COMPONENT_KEYS
                i = value
        elif k == "L" and head.level < 0 and (before in "=" or after in (":", "]", "|", "-") or quoted) and before != "":
            head.level = i
        elif k == "L" and head.level < 0 and seq[i].text.isupper() and (before.startswith("T_") or before == "]") and spaced(i + 1):
            head.level = i
        elif k == "L" and i == 0 and after == ":" and kind(2) == "C" and kind(3) == ":" and not spaced(1) and not spaced(2) and not spaced(3):
            return Header(level=0, component=2, length=4)  # LEVEL:name:
        elif k == "1" and head.level < 0 and ((i == 0 and after == "T_md") or (before == "[" and after == "]") or (before == "]" and spaced(i) and spaced(i + 1))):
            head.level = i
        elif k in ("C", "P") and head.component < 0 and (
            (after == "[" and kind(i + 2) == "N" and kind(i + 3) == "]")  # task[pid]
            or (before == "[" and after == "]")  # [module]
            or (before in ("-", "|") and after in ("-", "|"))  # - module -
            or (after == ":" and kind(i + 2) == "N" and kind(i + 3) == "]" and head.ts >= 0)  # file.cc:12]
            or before == "="
            or quoted
        ):
            head.component = i
            if after in ("[", ":") and kind(i + 2) == "N":
                i += 3
        elif k == "P" and i == 0 and after == ":" and kind(2) == "N":
            # file:line:column: level:
            j = 3
            if kind(j) == ":" and kind(j + 1) == "N":
                j += 2
            if kind(j) == ":" and kind(j + 1) == "L" and kind(j + 2) == ":":
                return Header(level=j + 1, component=0, length=j + 3)
            return None
        elif k == "N" and head.ts >= 0 and kind(head.ts) == "T_md" and head.component < 0:
            pass  # a thread number
        elif k == "C" and before.startswith("T_") and after == "C" and (kind(i + 2) == "[" or (kind(i + 2) == ":" and seq[i].typed and spaced(i + 3))):
            pass  # a host before task[pid] or before name:
        elif k == "C" and head.component < 0 and head.ts >= 0 and head.level < 0 and after == ":" and not spaced(i + 1) and spaced(i + 2) and (before.startswith("T_") or (before == "C" and kind(i - 2).startswith("T_"))):
            head.component = i  # name: behind a time or a host
            head.length = i + 2
            return head
        elif k == "C" and head.ts >= 0 and head.level == i - 1 and kind(head.level) == "L" and spaced(i) and ("." in seq[i].text or len(seq[i].values) >= SLOT_VALUES):
            # A name behind the level without delimiters: by its dots, or a slot of the template.
            head.component = i
            i += 2 if after in ("-", ":", "|") else 1
            break
        else:
            break
        i += 1
    head.length = i
    if head.ts >= 0 and (head.level >= 0 or head.component >= 0):
        return head
    if head.ts < 0 and kind(0) == "[" and head.component == 1 and kind(2) == "]" and seq[1].text.upper() == seq[1].text and spaced(3):
        head.length, head.level, head.tag = 3, -1, True
        return head
    if head.level >= 0 and head.keys:
        return head
    return None


def common(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two sequences."""
    n, m = len(a), len(b)
    size = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


GAP = Token("*", "", False)


def merge(a: list[Token], b: list[Token], pairs: list[tuple[int, int]]) -> list[Token]:
    """The template of two: what is in common stays, names that differ become one slot, other
    differences a gap."""
    out: list[Token] = []
    i = j = 0
    for x, y in [*pairs, (len(a), len(b))]:
        left, right = a[i:x], b[j:y]
        if left or right:
            if len(left) == len(right) and all(p.kind == q.kind for p, q in zip(left, right)):
                out += [_joined(p, q) for p, q in zip(left, right)]
            elif not out or out[-1] is not GAP:
                out.append(GAP)
        if x < len(a):
            out.append(_joined(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def _joined(p: Token, q: Token) -> Token:
    values = p.values if p.values >= q.values else frozenset(sorted(p.values | q.values)[:KEPT_VALUES])
    return Token(p.kind, p.text if p.text == q.text else max(p.text, q.text) if p.kind not in ("C",) else (p.text or q.text), p.spaced if p.spaced == q.spaced else None, values)


def skeleton(seq: list[Token]) -> tuple:
    """Punctuation and times in order: what a cluster cannot differ in."""
    return tuple(t.kind for t in seq if len(t.kind) == 1 and not t.kind.isalnum() and t.kind != "*" or t.kind.startswith("T_"))


class Miner:
    """Clusters of token sequences by longest common subsequence.

    by_lcs False leaves each distinct sequence alone, to show what the clusters decide.
    """

    def __init__(self, by_lcs: bool = True) -> None:
        self.by_lcs = by_lcs
        self.clusters: dict[tuple, list[list]] = {}  # skeleton -> [[tokens, support]]
        self.seen: dict[str, list] = {}

    def add(self, line: str, support: int = 1) -> None:
        line = masked(line)
        known = self.seen.get(line)
        if known is not None:
            known[1] += support
            return
        if seq := tokens(line):
            self.seen[line] = self.put(seq, support)

    def put(self, seq: list[Token], support: int) -> list:
        """The cluster that takes the sequence: the first of its skeleton with enough in common
        and no gap within a header."""
        symbols = tuple(t.symbol for t in seq)
        group = self.clusters.setdefault(skeleton(seq), [])
        for known in group:
            if not self.by_lcs and known[2] != symbols:
                continue
            most = COMMON * max(len(known[2]), len(symbols))
            if known[2] == symbols:
                merged = merge(known[0], seq, [(i, i) for i in range(len(seq))])
            elif len(set(known[2]) & set(symbols)) < most - len(symbols) + len(set(symbols)) or len(pairs := common(known[2], symbols)) < most:
                continue
            else:
                merged = merge(known[0], seq, pairs)
            gap = next((i for i, t in enumerate(merged) if t is GAP), None)
            if gap is not None and any((h := classify(s)) and gap < h.length for s in (known[0], seq)):
                continue
            known[0], known[1], known[2] = merged, known[1] + support, tuple(t.symbol for t in merged)
            return known
        group.append([seq, support, symbols])
        return group[-1]

    def templates(self) -> list[tuple[int, tuple, int]]:
        """Merged templates: (header length, parts with gaps, support), largest first.  Header
        parts keep their spaces and the text of field names.

        A tag without time or level is a header only where its message has the constant words of
        a message that stands behind another header.
        """
        found = [(seq, support, classify(seq)) for group in self.clusters.values() for seq, support, _ in group]
        messages = [m for seq, _, head in found if head and not head.tag and (m := message_words(seq, head))]
        out = []
        for seq, support, head in found:
            if head and head.tag and not (self.by_lcs and alike(message_words(seq, head), messages)):
                head = None
            out.append((head.length if head else 0, shape(seq, head), support))
        return sorted(out, key=lambda t: (-t[2], repr(t)))


def message_words(seq: list[Token], head: Header) -> tuple:
    """The symbols behind the header up to the end, quotes and what stands behind them left out."""
    out = []
    for t in seq[head.length :]:
        if t.kind == '"' and out:
            break
        if out or t.kind not in ("]", ":", "|", "-", ",", '"', "=", "C") or (t.kind == "C" and t.text.lower() not in MESSAGE_KEYS):
            out.append(t.symbol)
    return tuple(out)


def alike(words: tuple, messages: list[tuple]) -> bool:
    """Whether one of messages has enough in common with words."""
    known = set(words)
    for m in messages:
        most = COMMON * max(len(words), len(m))
        if words and len(known & set(m)) >= min(len(known), most) * 0.5 and len(common(words, m)) >= most:
            return True
    return False


def shape(seq: list[Token], head: Header | None) -> tuple:
    """(kind, spaced, role, text) of each token; text only of field names and punctuation."""
    cut = head.length if head else 0
    parts = []
    for i, t in enumerate(seq):
        role = "" if head is None else {head.ts: "ts", head.level: "level", head.component: "component"}.get(i, "key" if i in head.keys else "")
        parts.append((t.kind, t.spaced if i < cut else False, role, t.text if role == "key" or (len(t.kind) == 1 and not t.kind.isalnum()) else ""))
    return tuple(parts)


_PIECES = {
    **TIMES,
    "H": r"0x[0-9A-Fa-f]+",
    "P": TOKENS["P"],
    "L": rf"(?i:{_WORDS})",
    "1": r"[A-Z]",
    "C": TOKENS["C"],
    "N": r"\d+",
}


def pattern(cut: int, parts: tuple) -> str:
    """A regular expression for the header of a template."""
    out = ["^"]
    for kind, spaced, role, text in parts[:cut]:
        piece = _PIECES.get(kind) or re.escape(kind)
        if kind == "T_md":
            piece = r"\d{4} \d\d:\d\d:\d\d\.\d+"
        if role == "key":
            piece = re.escape(text)
        elif role in ("ts", "level", "component"):
            # A tag that opens a line without a time is written in capitals.
            piece = r"[A-Z][A-Z0-9_]*" if cut == 3 and parts[0][0] == "[" else f"(?:{piece})"
            piece = f"(?P<{role}>{piece})"
        out.append((r"[ \t]*" if spaced is None else r"[ \t]+" if spaced else "") + piece)
    return "".join(out) + (r"(?=\s)" if cut == 3 and parts[0][0] == "[" else "")


def logical_lines(text: str) -> Iterator[tuple[int, int, str]]:
    """(first, last, line): lines counted from 1, colours removed, an object written over several
    lines as one."""
    if "\x1b" in text:
        text = _COLOUR.sub("", text)
    lines = [x.strip("﻿\r").rstrip() for x in text.split("\n")]
    i = 0
    while i < len(lines):
        if lines[i] == "{":
            j = i + 1
            while j < len(lines) and lines[j].lstrip().startswith('"'):
                j += 1
            closed = j < len(lines) and lines[j] == "}"
            if j > i + 1:
                last = j if closed else j - 1
                yield i + 1, last + 1, re.sub(r'"\s*:\s*"', '":"', "".join(x.strip() for x in lines[i : last + 1]))
                i = last + 1
                continue
        yield i + 1, i + 1, lines[i]
        i += 1


def can_start(line: str) -> bool:
    """False for lines that hold no time, level word or tag: they start no entry."""
    return line[:1] in "[{" or ":" in line and ("0:00" in line or ".000" in line or bool(_LEVEL_WORD.search(line))) or ".000" in line[:24]


def _written(seq: list[Token]) -> str:
    return json.dumps([[t.kind, t.text, t.spaced, sorted(t.values)] for t in seq])


def _read(text: str) -> list[Token]:
    return [GAP if k == "*" else Token(k, x, spaced, frozenset(values)) for k, x, spaced, values in json.loads(text)]


def mine(texts: DataFrame, column: str = "text", by_lcs: bool = True) -> list[tuple[int, tuple, int]]:
    """One merged template for each header shape of all texts, with its support.

    Distinct masked lines are clustered where they lie; the clusters are merged by skeleton over
    all tasks.  Only header shapes come to the driver: their number follows the programs that
    wrote the logs, not the lines.
    """

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        miner = Miner(by_lcs)
        seen: Counter = Counter()
        for batch in batches:
            for text in batch[column]:
                if text:
                    seen.update([x for _, _, line in logical_lines(text) if can_start(x := masked(line))])
            if len(seen) > 100_000:
                for line, n in seen.items():
                    miner.add(line, n)
                miner.seen.clear()
                seen.clear()
        for line, n in seen.items():
            miner.add(line, n)
        rows = [(repr(key), _written(seq), n) for key, group in miner.clusters.items() for seq, n, _ in group]
        yield from frames(rows, ["skeleton", "template", "support"])

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(miner: Miner) -> list[tuple]:
            out = []
            for group in miner.clusters.values():
                for seq, n, _ in group:
                    if head := classify(seq):
                        out.append((repr((head.length, shape(seq, head)[: head.length])), head.tag, json.dumps(message_words(seq, head)), n))
            return out

        miner, present, out = Miner(by_lcs), None, []
        for batch in batches:
            for key, text, n in zip(batch["skeleton"], batch["template"], batch["support"]):
                if key != present:
                    out += close(miner)
                    miner, present = Miner(by_lcs), key
                miner.put(_read(text), int(n))
            yield from frames(out, ["header", "tag", "message", "support"])
            out = []
        yield from frames(close(miner), ["header", "tag", "message", "support"])

    partial = texts.select(column).mapInPandas(partly, "skeleton string, template string, support long")
    same = partial.groupBy("skeleton", "template").agg(F.sum("support").alias("support"))
    merged = same.repartition("skeleton").sortWithinPartitions("skeleton", F.desc("support"), "template").mapInPandas(together, "header string, tag boolean, message string, support long")
    merged = cut_lineage(merged)
    from ast import literal_eval

    found = {r["header"]: int(r["n"]) for r in merged.where(~F.col("tag")).groupBy("header").agg(F.sum("support").alias("n")).collect()}
    # Tags without time or level: their messages are sought among those behind other headers, by
    # the words that both share.
    if by_lcs:
        words = F.filter(F.array_distinct(F.from_json("message", "array<string>")), lambda w: F.length(w) > 2)
        told = merged.where(~F.col("tag")).groupBy("message").agg(F.lit(0).cast("long").alias("n")).withColumn("header", F.lit(None).cast("string"))
        tags = merged.where("tag").groupBy("header", "message").agg(F.sum("support").alias("n"))
        every = told.unionByName(tags).withColumn("w", F.explode(words))
        often = every.groupBy("w").agg(F.count(F.lit(1)).alias("k"))
        # Messages that are alike share one of the rarer half of their words; frequent words, which
        # nearly all messages have, are never joined on.
        order = Window.partitionBy("header", "message").orderBy("k", "w")
        rare = every.join(often, "w").withColumn("at", F.row_number().over(order)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("header", "message"))).where(F.col("at") <= F.ceil(F.col("of") / 2))
        tagged = rare.where(F.col("header").isNotNull()).select("header", "n", F.col("message").alias("m"), "w")
        likely = tagged.join(rare.where(F.col("header").isNull()).select(F.col("message").alias("o"), "w"), "w").select("header", "m", "n", "o").distinct()

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ok = [alike(tuple(json.loads(m)), [tuple(json.loads(o))]) for m, o in zip(batch["m"], batch["o"])]
                yield batch[["header", "m", "n"]][ok]

        known = likely.mapInPandas(compare, "header string, m string, n long").distinct().groupBy("header").agg(F.sum("n").alias("n"))
        found |= {r["header"]: int(r["n"]) for r in known.collect()}
    return sorted([(*literal_eval(h), n) for h, n in found.items()], key=lambda t: (-t[2], repr(t)))


def layouts(templates: list[tuple[int, tuple, int]]) -> list[str]:
    """One pattern for each header shape, longer ones first."""
    found = {pattern(cut, parts): (len([p for p in parts[:cut] if p[2]]), cut) for cut, parts, _ in templates if cut}
    return sorted(found, key=lambda p: (-found[p][0], -found[p][1], p))


def entries_of(text: str, known: list[re.Pattern]) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(first_line, last_line, log_ts, log_level, component, message) of each entry of a text.

    A line without a header belongs to the entry above, before the first header to none; the
    last line of an entry is its last that is not blank.
    """
    open_entry: list | None = None
    for first, last, line in logical_lines(text):
        got = None
        for p in known:
            if got := p.match(line):
                break
        if got:
            if open_entry:
                yield tuple(open_entry)
            part = got.groupdict()
            level = (part.get("level") or "").lower()
            level = LEVEL_OF.get(level, "")
            open_entry = [first, last, part.get("ts") or "", level, part.get("component") or "", line[got.end() :].lstrip("]:|- \t\",")]
        elif open_entry and line.strip():
            open_entry[1] = last
            open_entry[5] += "\n" + line
    if open_entry:
        yield tuple(open_entry)


def parse_logs(rows: DataFrame, row_id: str, text: Column, patterns: list[str], messages: bool = False) -> DataFrame:
    """One row for each entry of text: row_id, first_line, last_line, log_ts, log_level,
    component and, if asked, message (with its further lines).

    Null and empty texts and texts without a header have no rows; what a header lacks is ''.
    """
    schema = "row_id string, first_line int, last_line int, log_ts string, log_level string, component string" + (", message string" if messages else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [re.compile(p) for p in patterns]
        for batch in batches:
            out: list[tuple] = []
            for key, value in zip(batch["row_id"], batch["text"]):
                if value:
                    out += [(key, *e[: 6 if messages else 5]) for e in entries_of(value, known)]
                if len(out) > 50_000:
                    yield from frames(out, names)
                    out = []
            yield from frames(out, names)

    return rows.select(F.col(row_id).cast("string").alias("row_id"), text.alias("text")).where(F.col("text").isNotNull()).mapInPandas(parse, schema)
