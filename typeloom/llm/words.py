"""Texts as words, in a form that case, markup, line breaks and character variants don't change."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"<[^<>\n]{1,80}>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐]\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits: entities decoded, tags and invisible characters dropped, words broken at a line's end
    joined, compatibility forms and accents folded, case folded. No words for null."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-" in text or "‐" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.casefold())
