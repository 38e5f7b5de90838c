"""Chat formatting of typed content parts, with an escape that can be undone.

Every turn becomes ``<s>[INST] role [/INST]``, a line break, its content, a line break,
``</s>`` and a line break. Text parts are escaped, other parts leave a placeholder and an
attachment with the number of tokens that it expands to. A control string in a text gets a
backslash behind its first character, one more if it has some already, so no text can end a
turn, and taking one away gives the text back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

# Strings of the template and placeholders of parts.
OPEN, CLOSE_ROLE, CLOSE = "<s>[INST] ", " [/INST]\n", "\n</s>\n"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
REST = r"(?:/?s>|/?INST\]|image>|audio>|document>)"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, TOKENS_A_SECOND, TOKENS_A_PAGE = 14, 25, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*" + REST + ")", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*" + REST + ")", "$1$2")


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    kinds = [field.split(":") for field in PART[len("struct<") : -1].split(",")]
    given = {"type": F.lit("text"), "text": text.cast("string")}
    return F.array(F.struct(*(
        given.get(name, F.lit(None).cast(kind)).alias(name) for name, kind in kinds
    )))


def visit(part: Column, cases: dict[str, Callable[[Column], Column]], other: Column) -> Column:
    """The case of a part's type."""
    found = None
    for kind, case in cases.items():
        value = case(part)
        found = F.when(part["type"] == kind, value) if found is None else found.when(part["type"] == kind, value)
    return found.otherwise(other)


def part_content(part: Column) -> Column:
    """Escaped text, or a placeholder; a part of unknown type or none counts as text."""
    texts = escape(F.coalesce(part["text"], F.lit("")))
    return visit(part, {k: lambda _, p=p: F.lit(p) for k, p in PLACEHOLDERS.items()}, texts)


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to; sizes that are null count as one unit."""

    def units(size: Column, unit: float) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.coalesce(size, F.lit(1)) / unit)).cast("long")

    return visit(
        part,
        {
            "image": lambda p: units(p["width"], PATCH) * units(p["height"], PATCH),
            "audio": lambda p: units(p["seconds"], 1 / TOKENS_A_SECOND),
            "document": lambda p: units(p["pages"], 1) * TOKENS_A_PAGE,
        },
        F.lit(0).cast("long"),
    )


def format_chats(
    turns: DataFrame,
    parts: Column,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    loss_role: str = "assistant",
) -> DataFrame:
    """``conv_id, formatted, loss_mask, attachments``, one row a conversation.

    ``parts`` is the array of :data:`PART` of a row (null: no parts). ``loss_mask`` holds one
    entry a turn: ``start`` and ``length`` in code points of ``formatted``, and ``within``,
    the start within the turn; the length is 0 where nothing is learned. ``attachments`` are
    numbered in their order of appearance. Turns are ordered by ``turn`` (nulls first), equal
    turns by role and content, and all are kept; a null role is an empty one; rows of a null
    conversation id form one conversation. Other columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    rows = rows.select(
        "conv_id", "turn", "role",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE_ROLE)).alias("head"),
        F.array_join(F.transform("parts", part_content), "").alias("content"),
        F.transform(
            F.filter("parts", lambda p: p["type"].isin(*PLACEHOLDERS)),
            lambda p: F.struct(
                p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")
            ),
        ).alias("attached"),
    )
    # lengths before a turn: a running sum over rows, so long conversations stay linear
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    size = F.length("head") + F.length("content") + F.lit(len(CLOSE))
    placed = rows.select(
        "conv_id",
        F.row_number().over(order).alias("no"),
        F.concat("head", "content", F.lit(CLOSE)).alias("piece"),
        "attached",
        F.struct(
            (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size
             + F.length("head")).cast("long").alias("start"),
            F.when(F.col("role") == loss_role, F.length("content")).otherwise(0)
            .cast("long").alias("length"),
            F.length("head").cast("long").alias("within"),
        ).alias("mask"),
    )
    grouped = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("no", "piece", "mask", "attached"))).alias("t")
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.col("t.mask").alias("loss_mask"),
        F.transform(
            F.flatten("t.attached"), lambda a, i: a.withField("number", i.cast("long"))
        ).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text`` from formatted conversations and their mask.

    ``turns`` are ``role`` and ``text`` as they were before escaping (placeholders stay);
    ``loss_text`` is what the mask covers, unescaped and joined with nothing between.
    """
    ended = F.split("formatted", CLOSE)
    pieces = formatted.select(
        "conv_id", "formatted", "loss_mask",
        F.slice(ended, F.lit(1), F.size(ended) - 1).alias("pieces"),
    )

    def turn(piece: Column) -> Column:
        head = F.locate(CLOSE_ROLE, piece)
        role = F.substring(piece, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)
        text = F.substring(piece, head + len(CLOSE_ROLE), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    def learned(piece: Column, mask: Column) -> Column:
        return unescape(F.substring(piece, (mask["within"] + 1).cast("int"), mask["length"].cast("int")))

    return pieces.select(
        "conv_id", "formatted",
        F.transform("pieces", turn).alias("turns"),
        F.array_join(F.zip_with("pieces", "loss_mask", learned), "").alias("loss_text"),
    )
