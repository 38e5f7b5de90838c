from textprep.functions.classes import DEVANAGARI, LATIN
from textprep.functions.cleaners import (
    CLEANERS,
    punct_lower,
    script_letters,
    script_only,
    script_strict,
    word_basic,
)
from textprep.functions.scalars import (
    as_text,
    decode_label,
    digest,
    index_to_label,
    row_order,
    seeded_key,
    seeded_normal,
    threshold,
)
from textprep.functions.text import (
    collapse_repeats,
    collapse_space,
    drop_hashtag,
    keep_script,
    keep_words,
    lower_case,
    sequence_tokens,
    split_space,
    strip_mention,
    strip_social,
    strip_url,
    unwrap_hashtag,
    with_bigrams,
    word_tokens,
)

__all__ = [n for n in dir() if not n.startswith("_")]
