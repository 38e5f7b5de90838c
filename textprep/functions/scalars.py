"""Small column helpers around labels, scores and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from textprep.functions.text import _col


def as_text(c: Column | str) -> Column:
    """Cast to string; a null stays null and never becomes a word."""
    return _col(c).cast("string")


def decode_label(c: Column | str, positive: str = "YES") -> Column:
    """1 for the positive word, 0 for anything else."""
    return F.when(_col(c) == positive, 1).otherwise(0)


def threshold(c: Column | str, cut: float = 0.5) -> Column:
    """Score to class, strictly above the cut."""
    return (_col(c) > cut).cast("int")


def index_to_label(c: Column | str, names: Sequence[str]) -> Column:
    """Class index to class name; an index outside the list gives null."""
    return F.get(F.array(*[F.lit(n) for n in names]), _col(c).cast("int"))


def digest(c: Column | str) -> Column:
    """32-byte content key of a text.

    Grouping and joining on it moves 32 bytes per row in place of the text, and
    SHA-256 keeps it as good as comparing the texts. Null has a key of its own,
    so nulls count as equal to each other.
    """
    return F.coalesce(F.unhex(F.sha2(_col(c), 256)), F.lit(b""))


def row_order(rank: Column | str, row_id: Column | str) -> Column:
    """Source rank and row id packed into one bigint that sorts like the pair.

    A fixed-width order keeps keep-first aggregates on the hash path. Ids must lie
    below 2**56 and ranks below 128, else the query fails rather than misorders;
    pass the two columns as a list to the dedup operators in that case.
    """
    r, i = _col(rank).cast("bigint"), _col(row_id).cast("bigint")
    fits = r.between(0, 127) & (i >= 0) & (i < (1 << 56))
    return F.when(fits, F.shiftleft(r, 56).bitwiseOR(i)).otherwise(
        F.raise_error(F.lit("row_order: rank or id out of range")).cast("bigint")
    )


def seeded_key(row_id: Column | str, seed: int) -> Column:
    """Hexadecimal key that puts rows in a reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), _col(row_id).cast("string")))


def seeded_normal(term: Column | str, dim: Column | int, scale: float, seed: int) -> Column:
    """``dim`` normal values that depend on the term and the seed only.

    Uniform values come from 52 bits of ``md5(seed|term|place|part)``.
    """
    size = dim if isinstance(dim, Column) else F.lit(dim)

    def unit(i: Column, part: int) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), _col(term), i.cast("string"), F.lit(str(part)))
        bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
        return (bits.cast("double") + 0.5) / float(1 << 52)

    def value(i: Column) -> Column:
        radius = F.sqrt(-2.0 * F.log(unit(i, 0)))
        return (F.lit(scale) * radius * F.cos(F.lit(2.0) * F.pi() * unit(i, 1))).cast("float")

    return F.transform(F.sequence(F.lit(1), size), value)
