"""Cleaner presets: fixed chains of the functions in :mod:`textprep.functions.text`.

Every preset maps null to null and is one ``Column`` expression, so Catalyst can
prune it, push filters around it and run it inside generated code. Stateless, so
the same expressions also apply to a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column

from textprep.functions import text as t
from textprep.functions.classes import DEVANAGARI


def word_basic(c: Column | str, marks: str = "keep") -> Column:
    """Word characters only; URLs starting with ``http`` and mentions removed."""
    c = t.strip_url(c)
    c = t.strip_mention(c, marks)
    c = t.keep_words(c, marks)
    return t.collapse_space(c)


def script_strict(
    c: Column | str, marks: str = "keep", scripts: Sequence[str] = (DEVANAGARI,)
) -> Column:
    """One script and basic punctuation; hashtags go with their word."""
    c = t.strip_social(c, marks)
    c = t.keep_script(c, scripts, extra='!?,.;:"', marks=marks)
    return t.collapse_space(c)


def script_letters(
    c: Column | str, marks: str = "keep", scripts: Sequence[str] = (DEVANAGARI,)
) -> Column:
    """One script, letters of any script, basic punctuation; hashtags unwrapped."""
    c = t.strip_url(c, wide=True)
    c = t.strip_mention(c, marks)
    c = t.unwrap_hashtag(c, marks)
    c = t.keep_script(c, scripts, extra="!?.,:;", letters=True, marks=marks)
    return t.collapse_space(c)


def script_only(
    c: Column | str, marks: str = "keep", scripts: Sequence[str] = (DEVANAGARI,)
) -> Column:
    """One script and basic punctuation; hashtags unwrapped first."""
    c = t.strip_url(c, wide=True)
    c = t.strip_mention(c, marks)
    c = t.unwrap_hashtag(c, marks)
    c = t.keep_script(c, scripts, extra="!?.,:;", marks=marks)
    return t.collapse_space(c)


def punct_lower(c: Column | str, marks: str = "keep") -> Column:
    """Lower-cased word characters with ``!`` and ``?``, repeats of those reduced."""
    c = t.strip_url(c, wide=True)
    c = t.strip_mention(c, marks)
    c = t.collapse_repeats(c)
    c = t.keep_words(c, marks, extra="!?")
    return t.lower_case(t.collapse_space(c))


CLEANERS: dict[str, Callable[..., Column]] = {
    "word_basic": word_basic,
    "script_strict": script_strict,
    "script_letters": script_letters,
    "script_only": script_only,
    "punct_lower": punct_lower,
}
