"""Texts to bare words: letter case, punctuation, layout, mark-up and spelling of characters gone."""

from __future__ import annotations

import html
import re
import unicodedata

_BLOCK = r"p|div|br|hr|li|ul|ol|td|th|tr|table|thead|tbody|h[1-6]|pre|blockquote|section|article|body|html|head|title|dd|dt|dl"
_BLOCK_TAG = re.compile(rf"</?(?:{_BLOCK})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
_HYPHEN = re.compile(r"[-‐‑]\s*?[\r\n]+[ \t]*(?:(?://+|#+|\*+|>+|--+|;+|%+|\|)[ \t]+)?(?=\w)")
# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "ɡ": "g", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "н": "h", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ѡ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
_LOOK = str.maketrans(LOOKALIKES)
_PUNCT = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace())) + b"\x1c\x1d\x1e\x1f"
_PUNCT = bytes(c for c in _PUNCT if c not in b"\x1c\x1d\x1e\x1f")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain(text: str) -> str:
    """Characters in one spelling: compatibility forms, accents and look-alikes folded, lower
    case, invisible characters gone."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text).casefold()
    text = unicodedata.normalize("NFKD", text).translate(_LOOK)
    return "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf", "Me"))


def without_markup(text: str) -> str:
    """Without tags and character references; block tags part words, inline tags do not."""
    if "<" in text and ">" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    return text


def bare_words(text: str) -> list[bytes]:
    """The words of a text as UTF-8: what blanks separate, letters and digits only."""
    text = without_markup(text)
    if not text.isascii():
        # Invisible characters first: they may stand inside a hyphenated line end.
        text = text.replace("­", "").replace("​", "")
    if "-" in text or "‐" in text or "‑" in text:
        text = _HYPHEN.sub("", text)
    if text.isascii():
        return text.encode().translate(_LOWER, _PUNCT).split()
    text = plain(text)
    if text.isascii():
        return text.encode().translate(_LOWER, _PUNCT).split()
    return "".join(c if c.isalnum() or c.isspace() else "" for c in text).encode().split()
