"""Word-level BPE with word ends: backtracking encoder and offset-table decoder.

A word's tokens are found left to right. An Aho-Corasick automaton gives all tokens that
match at each place; the longest is taken first, and kept only if it is compatible with the
token before it: merging the two tokens' letters by rank has to give just these two. A word
split into pairwise compatible tokens is the split that merging by rank gives, and every
beginning of a word has only one, so a place that led nowhere is never tried again and time
is linear in the word.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from textprep.llm.byte_bpe import byte_letters
from textprep.llm.common import ship, text_or_empty

END = "\n"  # stands for the word end; no letter of a byte-level vocabulary
# Fixed value: the file's pre-tokens for lower-case texts of code points up to 255. These
# texts are in normal form already.
LATIN_WORDS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)
KEPT_WORDS = 400_000
KEPT_PAIRS = 400_000
SLICE = 256  # rows that are held as results at a time


class _Kept(dict):
    """What ``find`` gives for short keys, started afresh when ``limit`` is reached."""

    def __init__(self, find, limit: int):
        super().__init__()
        self.find, self.limit = find, limit

    def __missing__(self, key):
        value = self.find(key)
        if len(key) < 100:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """Encoder and decoder of a tokenizers file with ``</w>`` word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | self.special).items()}
        self.rank = {i: -1 for i in names}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            token, pair = vocab[left + right], (vocab[left], vocab[right])
            if token in self.halves:
                raise ValueError(f"{path}: two merges make {left + right!r}")
            self.rank[token], self.halves[token], self.merges[pair] = rank, pair, rank
        spelled = {
            t.removesuffix(suffix) + END if t.endswith(suffix) else t: i
            for t, i in vocab.items()
            if t not in self.special
        }
        self.automaton = ahocorasick.Automaton()
        self.size: dict[int, int] = {}
        self.shorter: dict[int, int | None] = {}  # the longest token that begins a token
        for letters, number in spelled.items():
            self.automaton.add_word(letters, number)
            self.size[number] = len(letters)
            begins = (spelled.get(letters[:k]) for k in range(len(letters) - 1, 0, -1))
            self.shorter[number] = next((x for x in begins if x is not None), None)
        self.automaton.make_automaton()
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.pre_tokens = library.pre_tokenizer.pre_tokenize_str
        letter_of = {b: c for c, b in byte_letters().items()}
        self.to_letters = {
            c: "".join(letter_of[b] for b in chr(c).encode()) for c in range(256)
        }
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Kept(self._word, KEPT_WORDS)
        self.chunks = _Kept(self._chunk, KEPT_WORDS)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.token_text = OffsetTable([names.get(i, "").encode() + b" " for i in range(max(names) + 1)])
        self.number_text = OffsetTable([b"%d " % i for i in range(max(names) + 1)])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the letters of both tokens by rank gives the two tokens.

        Walks down the right edge of one and the left edge of the other, undoing the later
        merge each time. Two pieces that meet on the way must not merge before their own
        tokens take them up; of equal merges the one further left comes first.
        """
        rank, halves, merges = self.rank, self.halves, self.merges
        taken_left = taken_right = len(merges)
        while True:
            meeting = merges.get((left, right))
            if meeting is not None and meeting < taken_left and meeting <= taken_right:
                return False
            if rank[left] > rank[right]:
                taken_left, left = rank[left], halves[left][1]
            elif rank[right] >= 0:
                taken_right, right = rank[right], halves[right][0]
            else:
                return True

    def _compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.compatible(left, right)
        return known

    def _word(self, letters: str) -> bytes:
        """Packed ids of one pre-token, given in the vocabulary's letters."""
        letters += END
        ids: list[int] = []
        ends, dead = [0], set()
        token = self._longest(letters, 0)
        while True:
            while token is not None:
                end = ends[-1] + self.size[token]
                if end not in dead and (not ids or self._compatible(ids[-1], token)):
                    break
                token = self.shorter[token]
            if token is None:
                if not ids:
                    raise ValueError(f"no tokens for {letters[:50]!r}")
                dead.add(ends.pop())
                token = self.shorter[ids.pop()]
                continue
            ids.append(token)
            if end == len(letters):
                return array("I", ids).tobytes()
            ends.append(end)
            token = self._longest(letters, end)

    def _longest(self, letters: str, start: int) -> int | None:
        """The longest token at a place; the word end alone is none."""
        for _, token in self.automaton.iter_long(letters, start):
            return token
        return None

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of what stands between two spaces."""
        if not chunk:
            return b""
        if chunk.isascii() and chunk.isalpha():
            return self.words[chunk.lower()]
        parts = self.specials.split(chunk) if "|>" in chunk else [chunk]
        out = []
        for part in parts:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part.isascii() or max(part) <= "\xff":
                for word in LATIN_WORDS.findall(part.lower()):
                    out.append(self.words[word.translate(self.to_letters)])
            else:
                out.extend(self.words[w] for w, _ in self.pre_tokens(self.normalize(part)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit.

        Nothing in normalising or pre-tokenising looks across a space, so what stands
        between spaces is encoded on its own, and once if it is short.
        """
        return b"".join(map(self.chunks.__getitem__, text.split(" ")))

    def decode(self, ids: bytes) -> bytes:
        """Token texts joined by spaces, special tokens included."""
        return self.token_text.join(ids)[:-1]

    def decimal(self, ids: bytes) -> bytes:
        return self.number_text.join(ids)[:-1]


class OffsetTable:
    """All entries in one block of bytes and where each begins."""

    def __init__(self, entries: list[bytes]):
        self.block = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in entries])])

    def join(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        begin = self.begin[numbers]
        sizes = self.begin[numbers + 1] - begin
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        place = np.arange(ends[-1]) + np.repeat(begin - ends + sizes, sizes)
        return self.block[place].tobytes()


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder a Python worker."""
    return WordBpe(path)


def _mapped(df: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """``make()`` applied to slices of rows, so that few results are in memory at a time."""
    ship(df.sparkSession)

    def run(batches):
        step = None
        for batch in batches:
            step = step or make()
            for start in range(0, batch.num_rows, SLICE):
                arrays = step(batch.slice(start, SLICE))
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return df.mapInArrow(run, schema)


def encode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids`` with ids as little-endian 32-bit binary, one row per row.

    A null text is an empty one and has empty ids. Null doc ids and repeated rows are kept
    as they are; further columns are not read. Texts of any length are encoded whole.
    """

    def make():
        encoder = word_bpe(tokenizer_path)
        return lambda batch: [
            batch.column(0),
            pa.array([encoder.encode(x) for x in batch.column(1).to_pylist()], pa.binary()),
        ]

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return _mapped(source, ["doc_id", "ids"], make, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, decoded`` of ``doc_id, ids``: token texts joined by one space. Null or
    empty ids give an empty string."""

    def make():
        encoder = word_bpe(tokenizer_path)
        return lambda batch: [
            batch.column(0),
            pa.array([encoder.decode(x or b"").decode() for x in batch.column(1).to_pylist()]),
        ]

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return _mapped(
        encoded.select("doc_id", "ids"), ["doc_id", "decoded"], make, f"doc_id {kind}, decoded string"
    )


def round_trip(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass, reduced to digests.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``, of the decimal ids and of the decoded
    text, each joined by one space. One Python worker a core instead of two; rows as in
    :func:`encode`.
    """

    def make():
        encoder = word_bpe(tokenizer_path)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = [encoder.encode(x) for x in batch.column(1).to_pylist()]
            return [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(encoder.decimal(x)).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]),
            ]

        return step

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return _mapped(
        source, columns, make,
        f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
