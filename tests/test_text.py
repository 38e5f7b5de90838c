"""String functions and presets: golden rows and comparison with Python's ``re``."""

import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textprep import functions as fn


def apply(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", *[c.alias(f"c{j}") for j, c in enumerate(columns)]).collect()
    rows.sort(key=lambda r: r["i"])
    out = [list(r[1:]) for r in rows]
    return [r[0] for r in out] if len(columns) == 1 else out


@pytest.mark.parametrize(
    "text, column, strip, keep",
    [
        ("हिन्दी भाषा", lambda m: fn.keep_words("text", m), "हनद भष", "हिन्दी भाषा"),
        ("हिन्दी भाषा", lambda m: fn.word_tokens("text", m), [], ["हिन्दी", "भाषा"]),
        ("#हिन्दी", lambda m: fn.drop_hashtag("text", m), "िन्दी", ""),
        ("@राम", lambda m: fn.strip_mention("text", m), "ाम", ""),
        ("#हिन्दी", lambda m: fn.unwrap_hashtag("text", m), "हिन्दी", "हिन्दी"),
    ],
)
def test_marks(spark, text, column, strip, keep):
    assert apply(spark, [text], column("strip"), column("keep"))[0] == [strip, keep]


def test_marks_value_is_checked():
    with pytest.raises(ValueError):
        fn.word_basic("text", marks="drop")


def test_null_stays_null(spark):
    columns = [f("text") for f in fn.CLEANERS.values()]
    assert apply(spark, [None, "अ"], *columns)[0] == [None] * len(columns)


def test_urls(spark):
    texts = ["abcwwwxyz def", "see http://a.b/c?d=1#e now", "x https://q y", "httpx"]
    assert apply(spark, texts, fn.strip_url("text"), fn.strip_url("text", wide=True)) == [
        ["abcwwwxyz def", "abc def"],
        ["see  now", "see  now"],
        ["x  y", "x  y"],
        ["", ""],
    ]


def test_repeats_and_spaces(spark):
    assert apply(spark, ["!!??", "!?!?", "a!!!b??"], fn.collapse_repeats("text")) == [
        "!?", "!?!?", "a!b?",
    ]
    assert apply(spark, [" a\u001c\u0085b\t\n ", "   "], fn.collapse_space("text")) == [
        "a b", "",
    ]


def test_joiner_kept_between_letters_only(spark):
    texts = ["क्‍ष", "‍कa‌", "क ‍‌ ख"]
    kept = apply(spark, texts, fn.word_basic("text", marks="keep"))
    assert kept == ["क्‍ष", "कa", "क ख"]
    assert apply(spark, texts, fn.word_basic("text", marks="strip"))[0] == "कष"


def test_removal_can_join_text(spark):
    """Three passes look again at text that became adjacent, one alternation does not."""
    texts = ["@अhttp://x क", "#अ@आ end"]
    assert apply(spark, texts, fn.strip_social("text")) == ["://x क", " end"]


PYTHON = {
    "strip_mention": (lambda: fn.strip_mention("text", "strip"), lambda s: re.sub(r"@\w+", "", s)),
    "drop_hashtag": (lambda: fn.drop_hashtag("text", "strip"), lambda s: re.sub(r"#\w+", "", s)),
    "url": (lambda: fn.strip_url("text"), lambda s: re.sub(r"http\S+", "", s)),
    "keep_words": (lambda: fn.keep_words("text", "strip"), lambda s: re.sub(r"[^\w\s]", "", s)),
    "repeats": (lambda: fn.collapse_repeats("text"), lambda s: re.sub(r"([!?])\1+", r"\1", s)),
    "space": (lambda: fn.collapse_space("text"), lambda s: re.sub(r"\s+", " ", s).strip()),
    "tokens": (lambda: fn.word_tokens("text", "strip"),
               lambda s: re.findall(r"\b\w\w+\b", s.lower())),
    "split": (lambda: fn.split_space("text"), lambda s: s.split()),
    "letters": (
        lambda: fn.keep_script("text", extra="!?.,:;", letters=True, marks="strip"),
        lambda s: "".join(
            c for c in s if "ऀ" <= c <= "ॿ" or c.isalpha() or c.isspace() or c in "!?.,:;"
        ),
    ),
}

ALPHABET = st.sampled_from(
    list("abZ09_@#!?.,:;\"'/ \t\n \u0085\u001c ‍é")
    + [c for c in map(chr, range(0x900, 0x980)) if unicodedata.category(c) != "Cn"]
)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(ALPHABET | st.just("http"), max_size=30).map("".join), min_size=200, max_size=300))
def test_same_as_python(spark, texts):
    got = apply(spark, texts, *[column() for column, _ in PYTHON.values()])
    for text, row in zip(texts, got):
        for name, value in zip(PYTHON, row):
            assert value == PYTHON[name][1](text), (name, text)


@settings(max_examples=2, deadline=None)
@given(st.lists(st.lists(ALPHABET | st.just("http"), max_size=30).map("".join), min_size=200, max_size=300))
def test_cleaners_are_stable(spark, texts):
    """Trimmed, single-spaced, and nothing outside the class survives."""
    for name, clean in fn.CLEANERS.items():
        for marks in ("keep", "strip"):
            for out in apply(spark, texts, clean("text", marks=marks)):
                assert out == out.strip() and "  " not in out, name
                assert "@" not in out and "#" not in out, name


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(fn.with_bigrams("t")).collect()] == [
        ["a", "b", "c", "a b", "b c"], ["a"], [],
    ]


def test_scalars(spark):
    df = spark.createDataFrame([("YES", 0.5, 1), ("yes", 0.6, 0)], "w string, s double, i int")
    rows = df.select(
        fn.decode_label("w"), fn.threshold("s"), fn.index_to_label("i", ["no", "si"]),
    ).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "si"), (0, 1, "no")]


def test_row_order_sorts_like_the_pair_and_fails_outside(spark):
    df = spark.createDataFrame([(1, 0), (0, 1 << 55), (0, 3)], "r int, i bigint")
    rows = df.orderBy(fn.row_order("r", "i")).collect()
    assert [tuple(r) for r in rows] == [(0, 3), (0, 1 << 55), (1, 0)]
    with pytest.raises(Exception, match="row_order"):
        spark.range(1).select(fn.row_order(F.lit(0), F.lit(1 << 57))).collect()


def test_stream_uses_the_same_expressions(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("@a हिन्दी!! http://x",)], "text string").write.json(source)
    stream = spark.readStream.schema("text string").json(source)
    query = (
        stream.select(fn.word_basic("text").alias("clean_text"))
        .writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert [r[0] for r in spark.table("cleaned").collect()] == ["हिन्दी"]
