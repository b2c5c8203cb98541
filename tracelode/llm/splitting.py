"""Oversized texts to pieces under a limit, cut at natural boundaries, with overlap.

One regular expression with bounded quantifiers does the cutting: its alternatives are ordered
by the strength of the boundary and each consumes as much as the limit allows; the last one
takes any character, so a text without boundaries is cut too.  The parts it extracts are
disjoint and their concatenation is the text.  A piece is a part with up to ``overlap``
characters looked back from the part before, from a boundary where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"


def trimmed(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, f"\\A{_SPACE}+|{_SPACE}+\\z", "")


def _cut(least: int, most: int) -> str:
    """Alternatives in falling strength: blank line, line, line anywhere, sentence, word, character."""
    return "|".join(
        [
            rf".{{{least},{most}}}(?<=\n)(?<=\n{_SPACE}{{0,8}}\n)",
            rf".{{{least},{most}}}(?<=\n)",
            rf".{{1,{most}}}(?<=\n)",
            rf".{{{least},{most}}}(?<=[.!?;\x{{3002}}\x{{FF01}}\x{{FF1F}}]\s)",
            rf".{{{least},{most}}}(?<=[\x{{3002}}\x{{FF01}}\x{{FF1F}}])",
            rf".{{{least},{most}}}(?<=\s)",
            rf".{{1,{most}}}",
        ]
    )


def parts_pattern(limit: int, overlap: int) -> str:
    """The pattern of parts: the first may be as long as the limit, each later one leaves room
    for the overlap; a rest that fits is taken whole."""
    later = limit - overlap
    return (
        rf"(?s)\A.{{1,{limit}}}\z|\A(?:{_cut(limit // 2, limit)})|\G.{{1,{later}}}\z|\G(?:{_cut(later // 2, later)})"
    )


def split_parts(text: Column, limit: int, overlap: int) -> Column:
    """array<string>: disjoint parts whose concatenation is text; empty for null and ''."""
    return F.coalesce(F.filter(F.regexp_extract_all(text, F.lit(parts_pattern(limit, overlap)), 0), lambda p: p != ""), F.array().cast("array<string>"))


def lookback(part: Column, overlap: int) -> Column:
    """The end of a part, at most overlap characters, from the start of a line, sentence or word
    where the part has one there."""
    tail = F.right(part, F.lit(overlap))
    whole = F.length(part) <= overlap
    from_line = F.regexp_extract(tail, r"(?s)\A.{0,%d}?\n(.*\S.*)\z" % (overlap // 2), 1)
    from_sentence = F.regexp_extract(tail, r"(?s)\A.{0,%d}?[.!?;]\s(.*\S.*)\z" % (overlap // 2), 1)
    from_word = F.regexp_extract(tail, r"(?s)\A\S*\s(.*\S.*)\z", 1)
    return F.when(whole, part).when(from_line != "", from_line).when(from_sentence != "", from_sentence).when(from_word != "", from_word).otherwise(tail)


def split_oversized(df: DataFrame, key: str, text: Column, limit: int = 2000, overlap: int = 200, keep: dict[str, Column] | None = None) -> DataFrame:
    """(key, piece_no, n_pieces, n_overlap, piece, *keep) of each text above limit.

    piece is at most limit characters (code points); its first n_overlap are the last of the
    piece before.  Texts up to limit, null and empty ones have no rows.  Repeated rows give
    their pieces once.  Other columns of df are not read.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half of the limit")
    kept = keep or {}
    rows = (
        df.select(F.col(key), text.alias("__text"), *[c.alias(n) for n, c in kept.items()])
        .where(F.length("__text") > limit)
        .withColumn("__parts", split_parts(F.col("__text"), limit, overlap))
        .drop("__text")
        .withColumn(
            "__pieces",
            F.transform(
                "__parts",
                lambda part, i: F.struct(
                    F.when(i > 0, lookback(F.get("__parts", i - 1), overlap)).otherwise(F.lit("")).alias("before"), part.alias("part")
                ),
            ),
        )
    )
    # posexplode_outer: with posexplode a filter on the size is inferred that repeats the whole work.
    return (
        rows.select(key, F.size("__parts").alias("n_pieces"), *kept, F.posexplode_outer("__pieces").alias("__at", "__piece"))
        .select(
            key,
            (F.col("__at") + 1).alias("piece_no"),
            "n_pieces",
            F.length("__piece.before").alias("n_overlap"),
            F.concat("__piece.before", "__piece.part").alias("piece"),
            *kept,
        )
        .dropDuplicates([key, "piece_no"])
    )
