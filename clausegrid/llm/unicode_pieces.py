"""Pieces of a text by a tokenizer's pattern, with letters and numbers as the tokenizers' own Unicode version has them.

The regex module's Unicode tables are newer than those of the tokenizers, so the few code points on which they differ
would be cut otherwise. Texts below U+0500 can't hold one and take the plain pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

_BEYOND = re.compile("[Ԁ-\U0010ffff]")


def _members(property_: str) -> list[tuple[int, int]]:
    """Ranges of the code points that the tokenizers library counts under a property."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(property_), "removed", invert=True)
    out: list[tuple[int, int]] = []
    for start in range(0, 0x110000, 0x1000):
        chars = "".join(chr(c) for c in range(start, start + 0x1000) if not 0xD800 <= c <= 0xDFFF)
        for c in sorted({ord(c) for piece, _ in split.pre_tokenize_str(chars) for c in piece}) if chars else ():
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
    return out


@lru_cache(maxsize=2)
def _explicit(property_: str) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _members(property_))


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    out = pattern
    for property_ in (r"\p{L}", r"\p{N}"):
        inside = re.compile(r"(\[[^\]]*?)" + re.escape(property_))
        while inside.search(out):
            out = inside.sub(lambda m: m[1] + _explicit(property_), out)
        out = out.replace(property_, f"[{_explicit(property_)}]")
    return regex.compile(out)


def finder(pattern: str) -> Callable[[str], Callable]:
    """A function from a text to the compiled pattern that cuts it as the tokenizers do."""
    plain = regex.compile(pattern)
    return lambda text: plain if text.isascii() or not _BEYOND.search(text) else _compiled(pattern)
