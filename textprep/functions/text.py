"""String functions: ``Column`` in, ``Column`` out, no Python at run time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from textprep.functions.classes import (
    DEVANAGARI,
    JOINERS,
    SPACE,
    ZWJ,
    ZWNJ,
    not_space,
    word_class,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_url(c: Column | str, wide: bool = False) -> Column:
    """Remove ``http...`` up to the next whitespace; ``wide`` also ``www...``, even mid-word."""
    pattern = f"http{not_space()}+"
    if wide:
        pattern += f"|www{not_space()}+"
    return F.regexp_replace(_col(c), pattern, "")


def strip_mention(c: Column | str, marks: str = "keep") -> Column:
    return F.regexp_replace(_col(c), f"@[{word_class(marks)}]+", "")


def drop_hashtag(c: Column | str, marks: str = "keep") -> Column:
    """Remove a hashtag together with its word."""
    return F.regexp_replace(_col(c), f"#[{word_class(marks)}]+", "")


def unwrap_hashtag(c: Column | str, marks: str = "keep") -> Column:
    """Keep the hashtag's word, drop the ``#``."""
    return F.regexp_replace(_col(c), f"#([{word_class(marks)}]+)", "$1")


def strip_social(c: Column | str, marks: str = "keep") -> Column:
    """URLs, mentions and hashtags in one pass over the text.

    A single alternation is not the same as three passes: text that becomes
    adjacent by a removal is not looked at again.
    """
    word = word_class(marks)
    return F.regexp_replace(
        _col(c), f"http{not_space()}+|www{not_space()}+|@[{word}]+|#[{word}]+", ""
    )


def _keep_only(c: Column | str, members: str, marks: str) -> Column:
    """Remove every character outside ``members``.

    With ``marks='keep'`` a joiner survives between two letters (or marks), where it
    is part of the spelling, and goes everywhere else. Few texts hold a joiner; the
    others skip the rules about them, which double the time of the pattern.
    """
    members = members.replace(JOINERS, "")
    text = _col(c)
    plain = F.regexp_replace(text, f"[^{members}]+", "")
    if marks == "strip":
        return plain
    word_class(marks)
    joiner, letter = f"[{JOINERS}]", r"[\p{L}\p{M}]"
    before_other = f"{joiner}+(?!{letter}|{joiner})"
    after_other = f"{joiner}(?<!{letter}{joiner}){joiner}*"
    careful = f"[^{members}{JOINERS}]+|{before_other}|{after_other}"
    has_joiner = F.contains(text, F.lit(ZWNJ)) | F.contains(text, F.lit(ZWJ))
    return F.when(has_joiner, F.regexp_replace(text, careful, "")).otherwise(plain)


def keep_words(c: Column | str, marks: str = "keep", extra: str = "") -> Column:
    """Remove everything but word characters, whitespace and ``extra``."""
    return _keep_only(c, f"{word_class(marks)}{SPACE}{extra}", marks)


def keep_script(
    c: Column | str,
    scripts: Sequence[str] = (DEVANAGARI,),
    extra: str = "",
    letters: bool = False,
    marks: str = "keep",
) -> Column:
    """Keep the given script blocks, whitespace and ``extra``; ``letters`` adds any letter."""
    any_letter = r"\p{L}" if letters else ""
    return _keep_only(c, f"{''.join(scripts)}{any_letter}{SPACE}{extra}", marks)


def collapse_repeats(c: Column | str) -> Column:
    """Reduce a run of the same ``!`` or ``?`` to one."""
    return F.regexp_replace(_col(c), r"([!?])\1+", "$1")


def collapse_space(c: Column | str) -> Column:
    """Reduce runs of whitespace to one blank and trim both ends."""
    return F.trim(F.regexp_replace(_col(c), f"[{SPACE}]+", " "))


def lower_case(c: Column | str) -> Column:
    return F.lower(_col(c))


def split_space(c: Column | str) -> Column:
    """Whitespace-separated tokens, none of them empty."""
    return F.filter(F.split(_col(c), f"[{SPACE}]+"), lambda t: t != "")


def word_tokens(c: Column | str, marks: str = "keep") -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(
        F.lower(_col(c)), F.lit(f"[{word_class(marks)}]{{2,}}"), F.lit(0)
    )


# Characters that the sequence tokenizer turns into blanks.
SEQUENCE_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'


def sequence_tokens(
    c: Column | str, filters: str = SEQUENCE_FILTERS, lower: bool = True
) -> Column:
    """Filter characters become blanks, then split on single blanks; empty tokens go."""
    text = F.lower(_col(c)) if lower else _col(c)
    if filters:
        text = F.translate(text, filters, " " * len(filters))
    return F.filter(F.split(text, " ", -1), lambda t: t != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use at several places of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_bigrams(tokens: Column | str) -> Column:
    """The tokens followed by all adjacent pairs joined by a blank."""

    def both(t: Column) -> Column:
        pairs = F.greatest(F.size(t) - 1, F.lit(0))
        follow = F.zip_with(
            F.slice(t, F.lit(1), pairs), F.slice(t, F.lit(2), pairs),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return F.concat(t, follow)

    return let(_col(tokens), both)
