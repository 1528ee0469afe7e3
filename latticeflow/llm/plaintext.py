"""Text as a reader sees it: markup, layout, case and the way characters are encoded taken away."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]{0,200}>", re.S)
_HYPHEN = regex.compile(r"(?<=[\p{L}\p{N}])[-‐‑][ \t]*\r?\n[ \t>|*]*(?=[\p{L}\p{N}])")
_MARK = regex.compile(r"[\p{M}\p{Cf}\p{Cc}]")
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")
#: Scripts that are written without blanks: each character is a word.
_NO_BLANKS = regex.compile(r"([\p{Han}\p{Hiragana}\p{Katakana}])")


def decoded(text: str) -> str:
    """Entities decoded, tags replaced by blanks."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    return _TAG.sub(" ", text) if "<" in text else text


def reader_words(text: str) -> list[str]:
    """Words of letters and digits without case, accents, punctuation and invisible characters; broken words are joined."""
    text = decoded(text)
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKD", text).casefold()
        text = _MARK.sub(lambda m: m[0] if m[0] in "\t\n\r\x0b\x0c\x85" else "", text)
        text = _NO_BLANKS.sub(r" \1 ", text)
    return [w for w in (_NOT_WORD.sub("", w) for w in text.split()) if w]
