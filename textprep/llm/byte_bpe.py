"""Byte-level BPE ids of whole texts, from a tokenizers file."""

from __future__ import annotations

import functools
import json
import struct
from array import array

import tiktoken

# Fixed value: the pre-token pattern of this family of tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(token: str, letters: dict[str, int]) -> bytes:
    return bytes(letters[c] for c in token)


class ByteBpe:
    """``pack(text)``: the ids that the tokenizers file gives, as little-endian 32-bit.

    Special tokens in a text get their id, as the file's library does it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {
            token_bytes(t, letters): i for t, i in spec["model"]["vocab"].items() if t not in special
        }
        merges = spec["model"]["merges"]
        first = len(ranks) - len(merges)
        for i, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if ranks[token_bytes(left + right, letters)] != first + i:
                raise ValueError(f"{path}: ids do not follow the order of merges")
        self.core = tiktoken.Encoding(
            "from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.special = special

    def ids(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        return self.core.encode_ordinary(text)

    def pack(self, text: str) -> bytes:
        for name, number in self.special.items():
            if name in text:
                return struct.pack("<I", number).join(map(self.pack, text.split(name)))
        return packed(self.ids(text))


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder a Python worker."""
    return ByteBpe(path)
