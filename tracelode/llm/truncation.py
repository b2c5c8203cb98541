"""Values that were cut off before their author or program had finished.

A value is cut where its last segment (sentence or line) is a strict prefix of longer segments
elsewhere.  Segments are compared in a form in which numbers, identifiers and paths are slots.

1. Self-join by prefix (prefixes.py): the last segment of each value, up to its end, against all
   complete segments.  Where longer ones go on behind it and hardly any end there, the value is
   cut; where segments end there, it is whole.  Identifiers that end a value are joined the same
   way with the pairs of parts of all identifiers.
2. What no longer segment starts with and none equals is looked up by token windows: fixed-length
   runs of tokens with what follows them elsewhere.  The last token is unknown here but a prefix
   of one that follows: cut inside a word; it is known but a segment never ends there: cut inside
   a sentence; tokens that follow neither are what was put behind, and are passed over.
3. What neither can see, as a number that may have lost digits, is decided by the length: where
   the values of a source pile up at one length, an open ending there is a cut.

The column ending names the step that decided: prefix, whole, window, open.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.prefixes import END, prefix_counts
from tracelode.operators.frames import frames
from tracelode.operators.skew import salted_left_join, spread
from tracelode.session import cut_lineage

#: Lengths of the token windows, longer first.
WINDOWS = (3, 2, 1)
#: Least share of the segments that start with a last segment, or with a window, that must end
#: there for an end there to count as one.
END_SHARE = 0.02
#: Segments of a layout from which on "all are closed by a bracket" is believed.
CLOSED_LEAST = 20
#: A length is a limit when so many values have it, it stands out from its neighbours and few
#: values are longer.
LIMIT_LEAST, LIMIT_TIMES, LIMIT_AROUND, LIMIT_LONGER = 5, 4, 10, 4

_COLOUR = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"'(]?[A-ZÀ-Þ])")
_WORDS = r"(?:trunc|cut|more|snip|clip|omit)"
_MARK = re.compile(rf"(?:\[(?:\.{{3}}|…|[^\[\]]{{0,24}}{_WORDS}[^\[\]]{{0,24}})\]|\({_WORDS}[^()]{{0,24}}\)|<[^<>]{{0,12}}{_WORDS}[^<>]{{0,24}}>)$", re.I)
#: No bracketed mark is longer.
_MARK_MOST = 64
_RUN = re.compile(r"[A-Za-z0-9_]+")
_LETTERS = string.ascii_letters + string.digits + "_"
_IDENT = re.compile(r"[A-Za-z0-9]*_[A-Za-z0-9_]*")
_NAME = re.compile(r"[A-Za-z0-9_+-]+")
_CAMEL = re.compile(r"[a-z]+[A-Z]\w*")
_DIGITS = str.maketrans("123456789", "000000000")
_CODE = set("/\\_()=\"‘’“”'{}<>&;|[]#$%")
_EDGES = ".,;:!?…"


def mask(token: str) -> tuple[str, str]:
    """(form, context form) of a token.

    The form keeps plain words, so that a prefix of a word shows; the context form also masks
    names written in camel case.
    """
    bare = token.rstrip(_EDGES)
    if not bare:
        return token[:1], token[:1]
    if bare.startswith("0x"):
        return (form := "0x" + "h" * (len(bare) - 2)), form
    if re.search(r"\d\d[:/-]\d\d|\d\dT\d\d", bare):
        form = re.sub(r"\d", "0", _IDENT.sub("w", bare)) if len(bare) < 40 else re.sub(r"\d+", "0", _NAME.sub("w", bare))
        return form, form
    if any(c in _CODE for c in bare) and any(c.isalnum() for c in bare):
        form = _NAME.sub(lambda m: "0" if m.group().isdigit() else "w", bare)
        return form, form
    if any(c.isdigit() for c in bare):
        return (form := re.sub(r"\d+(?:\.\d+)*", "0", bare)), form
    if re.fullmatch(r"\^~*", bare):
        return bare, "^"  # a marker under code: its length shows where it was cut
    if re.fullmatch(r"[-~=*#+]{2,}", bare):
        return (form := bare[0] * 2), form
    if re.fullmatch(r"[a-z]+[A-Z]\w*", bare):
        return bare, "I"
    return bare, bare


def segments(text: str) -> list[str]:
    """Sentences of prose and lines of output, blank ones left out."""
    out = []
    for line in _COLOUR.sub("", text).replace("\r", "").split("\n"):
        if line.strip():
            out += [s for s in _SENTENCE.split(line) if s.strip()]
    return out


class Masks:
    """mask() of tokens with what is known of tokens kept; digits do not part tokens."""

    MOST = 200_000

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def of(self, segment: str) -> list[str]:
        out = []
        for t in segment.translate(_DIGITS).split():
            form = self.known.get(t)
            if form is None:
                if len(self.known) >= self.MOST:
                    self.known.clear()
                form = self.known[t] = mask(t)[0]
            out.append(form)
        return out


def context_form(form: str) -> str:
    """The form of a token as something that stands before another."""
    return "^" if form[:1] == "^" else "I" if _CAMEL.fullmatch(form) else form


def identifier_pair(segment: str) -> str:
    """The last two parts of an identifier that ends the segment, else empty."""
    bare = segment.rstrip(_EDGES + "’\"'")
    parts = bare[len(bare.rstrip(_LETTERS)) :].lstrip("_").split("_")
    return "_".join(parts[-2:]) if len(parts) > 1 and parts[-2] else ""


def identifier_pairs(segment: str) -> Iterator[str]:
    """Each two neighbouring parts of an identifier, closed by _ where a part follows, else by
    END."""
    for m in _RUN.finditer(segment):
        parts = m.group().split("_")
        for i in range(len(parts) - 1):
            if parts[i] and parts[i + 1]:
                yield f"{parts[i]}_{parts[i + 1]}" + (END if i + 2 == len(parts) else "_" + END)


def without_marks(text: str) -> str:
    """The text without what says that it was cut: dots, replacement characters, bracketed words.
    A text without such marks stays as it is."""
    base = text
    while True:
        bare = base.rstrip()
        if bare.endswith("..."):
            base = bare.rstrip(".")
        elif bare.endswith(("…", "�")):
            base = bare[:-1]
        elif m := _MARK.search(bare[-_MARK_MOST:]):
            base = bare[: len(bare) - len(m.group())]
        else:
            return bare if base is not text else text


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def window_keys(tokens: list[str], context: list[str], field: str) -> Iterator[int]:
    """Hashes of (window, next token), (window, strict prefix) and (window, end)."""
    yield _key(field, "l", context[0], closer(tokens[-1]))
    for k in WINDOWS:
        padded = ["\x02"] * k + context
        for i, token in enumerate([*tokens, END]):
            where = "\x1e".join(padded[i : i + k])
            yield _key(field, "t", where, token)
            if token != END:
                yield _key(field, "c", where)
                for size in range(1, len(token)):
                    yield _key(field, "p", where, token[:size])


def closer(form: str) -> str:
    """The bracket that closes a segment, if one does."""
    return form[-1] if form[-1:] in (")", "]", "}") else ""


def segment_counts(values: DataFrame) -> DataFrame:
    """(field, kind, s, n): the distinct forms of all complete segments (kind s) and pairs of
    identifier parts (kind i) of values (columns field and text), with counts.

    The last segment of a value is left out: it is what is in question.  Equal ones are counted
    once and weighed, first in each batch, then over all.
    """

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        masks = Masks()
        for batch in batches:
            for field, text in zip(batch["field"], batch["text"]):
                if text:
                    for s in segments(text)[:-1]:
                        seen[field, "s", " ".join(masks.of(s)) + END] += 1
                        if "_" in s:
                            seen.update((field, "i", p) for p in identifier_pairs(s))
            if len(seen) > 200_000:
                yield from frames([(*k, n) for k, n in seen.items()], ["field", "kind", "s", "n"])
                seen.clear()
        yield from frames([(*k, n) for k, n in seen.items()], ["field", "kind", "s", "n"])

    return values.select("field", "text").mapInPandas(collect, "field string, kind string, s string, n long").groupBy("field", "kind", "s").agg(F.sum("n").alias("n"))


def model(distinct: DataFrame) -> DataFrame:
    """(key, n): counts of the token windows of all distinct forms (field, s, n)."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys: Counter = Counter()
            for field, s, n in zip(batch["field"], batch["s"], batch["n"]):
                tokens = s.rstrip(END).split(" ")
                for key in window_keys(tokens, [context_form(t) for t in tokens], field):
                    keys[key] += n
            yield from frames(list(keys.items()), ["key", "n"])

    return distinct.select("field", "s", "n").mapInPandas(expand, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def questions(field: str, tail: str, head: str) -> list[tuple[str, int]]:
    """(slot, key) of everything the decision on a tail needs."""
    t = tail.split(" ")
    c = [context_form(x) for x in t]
    asked = []
    for j in range(len(t)):
        for k in WINDOWS:
            padded = ["\x02"] * k + c
            before, after = "\x1e".join(padded[j : j + k]), "\x1e".join(padded[j + 1 : j + 1 + k])
            asked += [(f"t{k}.{j}", _key(field, "t", before, t[j])), (f"p{k}.{j}", _key(field, "p", before, t[j])), (f"e{k}.{j}", _key(field, "t", after, "\x04")), (f"c{k}.{j}", _key(field, "c", after))]
    return asked + [(f"l{b}", _key(field, "l", c[0], b)) for b in ("", ")", "]", "}")]


def verdict(tail: str, head: str, n: dict[str, int]) -> str:
    """cut, open or whole; open where nothing is known of the ending."""
    stopped = head == "."
    t = tail.split(" ") if tail else []
    get = lambda slot: n.get(slot, 0)
    last = len(t) - 1
    for j in range(last, -1, -1):
        # Behind a dropped token a window of one token is too weak to tell that the text goes on.
        trusted = WINDOWS if j == last else WINDOWS[:-1]
        known = any(get(f"t{k}.{j}") for k in trusted)
        if stopped and j == last and t[j].isalpha() and (known or not any(get(f"p{k}.{j}") for k in WINDOWS)):
            return "whole"  # a word with its full stop
        if not known:
            if any(get(f"p{k}.{j}") for k in trusted):
                return "cut"
            continue
        k = next((k for k in WINDOWS if get(f"e{k}.{j}") + get(f"c{k}.{j}") >= 2), None)
        if k is None:
            continue
        ends, goes = get(f"e{k}.{j}"), get(f"c{k}.{j}")
        if j == last:
            # Where all segments of this layout are closed by a bracket, one without it is cut.
            own, closed = get(f"l{closer(t[j])}"), max(get(f"l{b}") for b in (")", "]", "}"))
            if closed >= CLOSED_LEAST and own < END_SHARE * closed:
                return "cut"
        return "whole" if ends and ends >= END_SHARE * (ends + goes) else "cut"
    return "open"


def tail_of(text: str, masks: Masks | None = None) -> tuple[str, int, bool, bool, str, str]:
    """(form of the last segment, length without marks, surely cut, open ending, full stop or
    nothing, identifier pair that ends it)."""
    base = without_marks(text)
    sure = text.rstrip().endswith(("�", "\x00"))
    if "{" in base:
        lines = [x.strip() for x in _COLOUR.sub("", base).replace("\r", "").split("\n")]
        opened = max((i for i, x in enumerate(lines) if x == "{"), default=-1)
        closed = max((i for i, x in enumerate(lines) if x == "}"), default=-1)
        if opened > closed and all(x.startswith('"') or not x for x in lines[opened + 1 :]):
            sure = True  # an object that is never closed
    ending = base.rstrip()
    found = segments(ending[ending.rfind("\n") + 1 :]) or segments(base)
    last = found[-1] if found else ""
    stripped = last.strip()
    if stripped.startswith('{"') and not stripped.endswith("}"):
        sure = True
    if re.match(r"\w+=\S+ \w+=", stripped) and stripped.count('"') % 2:
        sure = True
    stop = "." if text.rstrip()[-1:] in (".", "!", "?") and ending == text.rstrip() else ""
    ending = base.rstrip("\r\n")
    is_open = ending[-1:] not in (".", "!", "?", ")", "]", "}", "~", "’", '"')
    return " ".join((masks or Masks()).of(last)), len(base), sure, is_open, stop, identifier_pair(last)


def limits_of(read_rows: DataFrame) -> DataFrame:
    """(field, source, size, at_limit): lengths at which the values of a source pile up."""
    lengths = read_rows.groupBy("field", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("field", "source").orderBy("size")
    around, beyond = by.rangeBetween(-LIMIT_AROUND, LIMIT_AROUND), by.rangeBetween(1, Window.unboundedFollowing)
    return (
        lengths.withColumn("near", F.sum("n").over(around) - F.col("n"))
        .withColumn("longer", F.coalesce(F.sum("n").over(beyond), F.lit(0)))
        .where(F.col("longer") <= LIMIT_LONGER * F.col("n"))
        .where((F.col("n") >= LIMIT_LEAST) & (F.col("n") >= LIMIT_TIMES * F.greatest(F.lit(1.0), F.col("near") / 4)))
        .select("field", "source", "size", F.lit(True).alias("at_limit"))
    )


def find_truncated(rows: DataFrame, keys: list[str], source: str, text: str, field: Column | None = None) -> DataFrame:
    """(*keys, source, field, cut, ending, at_limit) of every row whose text is not null or empty.

    cut is true where the text ends inside a word, a sentence or a message, whatever was put
    behind.  A text that is complete but ends without a full stop is no cut.  Rows of different
    field are judged apart; a null source is a source of its own.  Repeated rows stay repeated;
    what other columns hold does not matter.
    """
    # Keys travel as text: pandas would turn integers beside a null into floats.
    values = spread(
        rows.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(source).alias("source"), (F.lit("") if field is None else field).alias("field"), F.col(text).alias("text")).where(F.col("text") != ""), keys[0]
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = Masks()
        for batch in batches:
            got = [tail_of(t, masks) for t in batch["text"]]
            made = {name: [g[i] for g in got] for i, name in enumerate(["tail", "size", "sure", "is_open", "head", "pair"])}
            yield batch[[*keys, "source", "field"]].assign(**made)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = [(field, tail, head, slot, key) for field, tail, head in zip(batch["field"], batch["tail"], batch["head"]) for slot, key in questions(field, tail, head)]
            yield from frames(asked, ["field", "tail", "head", "slot", "key"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [verdict(tail, head, {a["slot"]: a["n"] for a in answers}) for tail, head, answers in zip(batch["tail"], batch["head"], batch["answers"])]
            yield pd.DataFrame({"field": batch["field"], "tail": batch["tail"], "head": batch["head"], "window": ends})

    kinds = ", ".join(f"`{c}` string" for c in keys)
    # The results of reading are short: they are kept in the shared folder and used several times.
    read_rows = cut_lineage(values.mapInPandas(read, f"{kinds}, source string, field string, tail string, size int, sure boolean, is_open boolean, head string, pair string"))
    complete = cut_lineage(segment_counts(values))

    named = lambda kind, s: F.concat_ws("\x01", "field", F.lit(kind) if isinstance(kind, str) else kind, s)
    tails = read_rows.select("field", "tail", "head", "pair").distinct()
    asked = tails.select(named("s", F.col("tail")).alias("s")).union(tails.where("pair != ''").select(named("i", F.col("pair"))))
    counts = cut_lineage(prefix_counts(complete.select(named(F.col("kind"), F.col("s")).alias("s"), "n"), asked))

    # cut: longer ones go on and hardly any end here; whole: enough of them end here.
    ends_here = (F.col("ends") > 0) & (F.col("ends") >= END_SHARE * (F.col("ends") + F.col("longer")))
    by_prefix = F.when(ends_here, "whole").when(F.col("longer") > 0, "prefix").otherwise("open")
    joined = counts.select("s", by_prefix.alias("by_prefix"))
    of_tail = tails.select("field", "tail", "head", "pair", named("s", F.col("tail")).alias("s")).join(joined, "s", "left").drop("s")
    of_pair = joined.select(F.col("s").alias("p"), (F.col("by_prefix") == "prefix").alias("part_cut"))
    decided = of_tail.withColumn("p", F.when(F.col("pair") != "", named("i", F.col("pair")))).join(of_pair, "p", "left").drop("p")

    unknown = decided.where((F.col("by_prefix") == "open") & (F.col("tail") != "")).select("field", "tail", "head").distinct()
    answers = (
        unknown.mapInPandas(ask, "field string, tail string, head string, slot string, key long")
        .join(model(complete.where("kind = 's'")), "key")
        .groupBy("field", "tail", "head")
        .agg(F.collect_list(F.struct("slot", "n")).alias("answers"))
    )
    windows = answers.mapInPandas(decide, "field string, tail string, head string, window string")
    by = ["field", "tail", "head", "pair"]
    ending = F.when(F.coalesce("part_cut", F.lit(False)), "prefix").when(F.col("by_prefix") != "open", F.col("by_prefix")).when(F.col("window") == "cut", "window").when(F.col("window") == "whole", "whole").otherwise("open")
    verdicts = decided.join(windows, ["field", "tail", "head"], "left").select(*by, ending.alias("ending"))

    placed = salted_left_join(read_rows, verdicts, by, F.col(keys[0]))
    limits = limits_of(read_rows).select(F.col("field").alias("f"), F.col("source").alias("o"), F.col("size").alias("z"), "at_limit")
    placed = placed.join(limits, F.col("field").eqNullSafe(F.col("f")) & F.col("source").eqNullSafe(F.col("o")) & (F.col("size") == F.col("z")), "left")
    at_limit = F.coalesce("at_limit", F.lit(False))
    ended = F.coalesce("ending", F.lit("open"))
    cut = F.col("sure") | ended.isin("prefix", "window") | (at_limit & F.col("is_open"))
    return placed.select(*[F.col(k).cast(rows.schema[k].dataType).alias(k) for k in keys], "source", "field", cut.alias("cut"), ended.alias("ending"), at_limit.alias("at_limit"))
