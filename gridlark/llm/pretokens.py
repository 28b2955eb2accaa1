"""Pre-tokens of byte-level BPE: how a text falls apart before merges run."""

from __future__ import annotations

import re

import regex

# The public pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
_RUN = re.compile(r"[\s\x1c-\x1f\x85] ")


def find(text: str) -> list[str]:
    return _SPLIT.findall(text)


def chunks(text: str) -> list[str]:
    """Keys of parts of a text that fall into pre-tokens independently of one another; raw() gives a key's part.

    A space before a word belongs to the word, so a text without two white spaces in a row, the second a space, can be cut
    before every space. What is between two cuts repeats often, which makes it a good cache key. Other texts
    are cut into pre-tokens at once. A key without a space stands for a space and the key, one that ends with a space for what is before that.
    """
    if _RUN.search(text):
        return [x + " " for x in find(text)]
    parts = text.split(" ")
    parts[0] += " "
    return parts


def raw(key: str) -> str:
    return key[:-1] if key.endswith(" ") else " " + key


def segments(text: str, special: dict[str, int]) -> list:
    """The text between special strings, and the id (int) of each special string, in order."""
    if not any(s in text for s in special):
        return [text] if text else []
    cut = re.split("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")", text)
    return [special.get(x, x) if odd else x for odd, x in ((i % 2, x) for i, x in enumerate(cut)) if x]

