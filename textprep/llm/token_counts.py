"""Token counts that follow edits: only what an edit touches is encoded again.

A document's pre-tokens stand in leaves of a segment tree that sums code points and tokens.
An edit finds the leaf by code point, splits the text again from a little before the edit
until a border falls on an old one, replaces these pre-tokens and renews the sums above.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from textprep.llm.byte_bpe import PATTERN, ByteBpe
from textprep.llm.common import ship, text_or_empty

EDIT = "struct<start:bigint,delete:bigint,insert:string>"
LEAF = 64  # pre-tokens of a leaf at first
CONTEXT = 3  # code points before an edit that a pre-token ending there may have looked at
KEPT = 500_000


class Counter:
    """Splits texts into pre-tokens and counts the tokens of one."""

    def __init__(self, path: str):
        self.encoder = ByteBpe(path)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = len(self.encoder.ids(piece))
            if len(piece) < 100:
                self.known[piece] = found
        return found

    def items(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """Length and tokens of every pre-token from ``start``."""
        for match in self.pattern.finditer(text, start):
            piece = match.group()
            yield len(piece), self.count(piece)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _packed(leaf: list[tuple[int, int]]) -> bytes:
    return np.array(leaf, "<u4").tobytes()


def _unpacked(leaf: bytes) -> list[tuple[int, int]]:
    return [(size, n) for size, n in np.frombuffer(leaf, "<u4").reshape(-1, 2).tolist()]


class CountedText:
    """A text with the segment tree of its pre-tokens."""

    def __init__(self, text: str, of: Counter, tree: list[bytes] | None = None):
        """``tree`` is what :meth:`tree` gave for this text; of another length it is not used."""
        self.text, self.of = text, of
        self.leaves = [] if tree is None else [_unpacked(leaf) for leaf in tree]
        if not self.leaves or sum(size for leaf in self.leaves for size, _ in leaf) != len(text):
            items = list(of.items(text))
            self.leaves = [items[i : i + LEAF] for i in range(0, len(items), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, leaf in enumerate(self.leaves):
            self._sum(i)
        for node in range(self.width - 1, 0, -1):
            self._join(node)
        self.encoded = 0  # code points encoded again by edits

    def tree(self) -> list[bytes]:
        """The leaves, to be taken up later; long ones are split, empty ones go."""
        split = [leaf[i : i + LEAF] for leaf in self.leaves for i in range(0, len(leaf), LEAF)]
        return [_packed(leaf) for leaf in split]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _sum(self, leaf: int) -> None:
        self.chars[self.width + leaf] = sum(size for size, _ in self.leaves[leaf])
        self.tokens[self.width + leaf] = sum(n for _, n in self.leaves[leaf])

    def _join(self, node: int) -> None:
        for sums in (self.chars, self.tokens):
            sums[node] = sums[2 * node] + sums[2 * node + 1]

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a code point, and the code points before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if before + self.chars[node] <= char:
                before += self.chars[node]
                node += 1
        return min(node - self.width, len(self.leaves) - 1), before

    def edit(self, start: int, delete: int, insert: str) -> None:
        """Replace ``delete`` code points at ``start`` by ``insert``; both are cut to the text."""
        start = max(0, min(start, len(self.text)))
        delete = max(0, min(delete, len(self.text) - start))
        text = self.text[:start] + insert + self.text[start + delete :]
        shift = len(insert) - delete
        safe = max(0, start - CONTEXT)
        first, border = self._leaf_at(safe)
        skip = 0
        while skip < len(self.leaves[first]) and border + self.leaves[first][skip][0] <= safe:
            border += self.leaves[first][skip][0]
            skip += 1
        # ``leaf, at``: the old pre-token that begins at ``old``; follows the new borders
        leaf, at, old, new = first, skip, border, border
        fresh = []
        for size, tokens in self.of.items(text, border):
            fresh.append((size, tokens))
            new += size
            if new < start + len(insert):
                continue
            while old < new - shift and leaf < len(self.leaves):
                if at < len(self.leaves[leaf]):
                    old += self.leaves[leaf][at][0]
                    at += 1
                else:
                    leaf, at = leaf + 1, 0
            if old == new - shift and old >= start + delete:
                break
        else:  # up to the end of the text
            leaf, at = len(self.leaves) - 1, len(self.leaves[-1])
        self.encoded += sum(size for size, _ in fresh)
        if leaf == len(self.leaves):
            leaf, at = leaf - 1, len(self.leaves[-1])
        rest = self.leaves[leaf][at:]
        self.leaves[first] = self.leaves[first][:skip] + fresh + rest
        for i in range(first + 1, leaf + 1):
            self.leaves[i] = []
        self.text = text
        for i in range(first, leaf + 1):
            self._sum(i)
        low, high = self.width + first, self.width + leaf
        while low > 1:
            low, high = low // 2, high // 2
            for node in range(low, high + 1):
                self._join(node)


def count_edited(
    docs: DataFrame,
    edits: Column,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tree_col: str | None = None,
    keep: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens, edited_tokens, edited_chars, encoded_again`` of every row.

    With ``keep`` also ``text`` and ``tree``, the edited text and its leaves: lengths and token
    counts of its pre-tokens. Store them, and a later call that is given ``tree_col`` goes on
    from there: it encodes what its own edits touch and nothing else. A null tree, or one that
    does not add up to the text's length, is built anew.

    ``edits`` is an array of :data:`EDIT`, applied in order, each to the text that the ones
    before it left; places beyond the text are cut to it. ``encoded_again`` counts the code
    points that edits made necessary to encode. Special tokens in a text are ordinary text.
    A null text is empty, null edits are none, a null insertion is empty. Null ids and
    repeated rows are kept; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_or_empty(text_col).alias("text"),
        F.coalesce(edits, F.array().cast(f"array<{EDIT}>")).alias("edits"),
        (F.lit(None).cast("array<binary>") if tree_col is None else F.col(tree_col)).alias("tree"),
    )
    names = ["doc_id", "n_tokens", "edited_tokens", "edited_chars", "encoded_again"]
    names += ["text", "tree"] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                out: list[tuple[int, ...]] = []
                kept: list[tuple[str, list[bytes]]] = []
                for text, changes, tree in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    counted = CountedText(text, of, tree)
                    before = counted.n_tokens
                    for x in changes:
                        if x is not None:
                            counted.edit(x["start"] or 0, x["delete"] or 0, x["insert"] or "")
                    out.append((before, counted.n_tokens, len(counted.text), counted.encoded))
                    if keep:
                        kept.append((counted.text, counted.tree()))
                arrays = [pa.array(c, pa.int64()) for c in zip(*out)]
                if keep:
                    texts, trees = zip(*kept)
                    arrays += [pa.array(texts, pa.string()), pa.array(trees, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)

    kinds = ["long"] * 5 + ["string", "array<binary>"]
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
