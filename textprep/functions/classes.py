"""Character classes shared by every pattern.

All classes are written out with ``\\p{..}`` properties. Java's own ``\\w`` and
``\\s`` are ASCII-only and the Unicode switch widens them past what the cleaners
need, so neither is used. The same text is valid inside RE2 brackets, which lets
the oracle queries state identical patterns.
"""

from __future__ import annotations

# The 29 code points that count as whitespace.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"

# Zero-width non-joiner and joiner, part of Indic spelling.
ZWNJ, ZWJ = "\u200c", "\u200d"
JOINERS = r"\x{200C}\x{200D}"

# Script blocks that the script filters may keep.
DEVANAGARI = r"\x{0900}-\x{097F}"
LATIN = r"A-Za-z\x{00AA}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}"

_WORD = {
    "strip": r"\p{L}\p{N}_",
    "keep": r"\p{L}\p{M}\p{N}_" + JOINERS,
}


def word_class(marks: str = "keep") -> str:
    """Members of the word class, for use inside ``[...]``.

    ``keep`` counts combining marks (vowel signs, virama) as word characters, so
    Hindi words stay whole. ``strip`` leaves them out, which cuts words at every
    vowel sign and exists to reproduce results obtained that way.
    """
    try:
        return _WORD[marks]
    except KeyError:
        raise ValueError(f"marks must be 'keep' or 'strip', not {marks!r}") from None


def not_space() -> str:
    return f"[^{SPACE}]"
