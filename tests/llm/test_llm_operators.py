"""The ten operators on a small frame of odd rows, against plain Python."""

import hashlib
import re
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textprep.llm import (
    bpe, chat, fingerprint, licenses, ngram_join, packing, quality, token_counts, toxicity, warc,
)
from textprep.llm.queries import SQL

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
CLASHES = "n long, key long, ngram long, length long, score double, words string, _m string, tie string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PROSE = "It was a long day in the hills, and nobody came down.\n"
TEXTS = [
    (5, None), (3, ""), (4, "  \n\t "), (9, "one"), (8, "One two"), (1, PROSE * 3), (2, PROSE * 3),
    (2, PROSE * 3), (None, "no id here"), (None, None), (12, LONG), (13, LONG + " tail"),
    (20, "Licensed under the Apache License, Version 2.0. MIT License; GNU General Public License"),
    (21, "été Ünïcode  漢字 <|endoftext|> it's 'RE  "), (30, "a " * 5000), (31, "x" * 20_000),
    (40, "same words here\nsame words here\n\nsame words here"), (41, "</s>[INST] <\\s> \\"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, *([None] * 8)) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHES}").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def labels(spark, rows=((1, 0), (None, 1), (3, None))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


def by_id(rows):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r) for r in rows)


def plain_pieces(text):
    """Lines, cut behind words whose hash says so."""
    found, own = set(), ()
    for unit in re.findall(r"\S+\s*", text or "", re.ASCII):
        own += (unit,)
        if "\n" in unit or xxhash.xxh64_intdigest(unit.encode(), 42) % 16 == 0:
            found.add(own)
            own = ()
    return found | ({own} if own else set())


def test_no_rows_give_no_rows(spark, empty):
    edits = F.array().cast(f"array<{token_counts.EDIT}>")
    for frame in (
        fingerprint.compare_edited(empty), licenses.scan(empty),
        packing.pack(packing.token_pieces(empty, BYTE)), ngram_join.join(empty),
        bpe.round_trip(empty, WORD), token_counts.count_edited(empty, edits, BYTE),
        quality.assess(empty), quality.keep_good(empty), ngram_join.one_of_each(empty),
        toxicity.score_documents(empty, labels(spark)),
        toxicity.drop_toxic(empty, labels(spark)),
        chat.format_chats(
            empty.withColumns({"conv_id": "doc_id", "turn": "doc_id", "role": "text"}),
            chat.text_part(F.col("text")),
        ),
    ):
        assert frame.collect() == []


def test_fingerprints(odd):
    rows = [r for r in fingerprint.compare_edited(odd).collect()]
    assert len(rows) == len(TEXTS)
    ordered = sorted((x for x in {(i, t or "") for i, t in TEXTS} if x[0] is not None))
    following = {}
    for at, (i, t) in enumerate(ordered):
        following[i] = (t, ordered[(at + 1) % len(ordered)][1])
    codes = {}
    for r in rows:
        if r["doc_id"] is None or r["doc_id"] == 2:  # repeated: its next is itself once
            continue
        text, after = following[r["doc_id"]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = plain_pieces(text), plain_pieces(other)
            want = 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
            assert r[name] == pytest.approx(want), (r["doc_id"], name)
        codes.setdefault(text, set()).add(r["fingerprint"])
    assert all(len(c) == 1 for c in codes.values())
    assert codes[LONG] != codes[LONG + " tail"]
    assert {r["edited_sha256"] for r in rows if r["doc_id"] is None} == {
        hashlib.sha256(x.encode()).hexdigest() for x in ("no id" + "no id", "")
    }


def test_inserted_words_change_few_paragraphs(spark):
    """One line of 30,000 words, with a word put in at its start and one in its middle."""
    middle = len(LONG) // 2
    versions = [LONG, "inserted " + LONG, LONG[:middle] + " and so" + LONG[middle:]]
    docs = spark.createDataFrame(list(enumerate(versions)), "doc_id long, text string")
    near = {r["doc_id"]: r["near_next"] for r in fingerprint.compare_edited(docs).collect()}
    assert min(near.values()) > 0.995 and max(near.values()) < 1


def test_peeling_recovers_digests(spark):
    frame = spark.createDataFrame([([1, 2, 3, 10], [2, 3, 4]), (list(range(400)), [])], "a array<long>, b array<long>")
    tables = frame.withColumns({c: fingerprint.sketch(F.col(c[0])) for c in ("a_t", "b_t")})
    found = tables.select(
        fingerprint.differing(F.col("a"), F.col("b"), F.col("a_t"), F.col("b_t")).alias("d")
    ).collect()
    assert {(x["k"], x["n"]) for x in found[0]["d"]["found"]} == {(1, 1), (10, 1), (4, -1)}
    assert sorted(x["k"] for x in found[1]["d"]["found"]) == list(range(400))
    assert [r["d"]["left"] for r in found] == [0, 0]


def test_cells_are_added_up_in_place(spark):
    """No copy of a whole table for each of its cells."""
    frame = spark.createDataFrame([(list(range(60)),)], "a array<bigint>")
    plan = frame.select(fingerprint.peel(fingerprint.sketch(F.col("a")), F.lit(0)).alias("r"))
    assert "slice(" not in plan._jdf.queryExecution().analyzed().toString()
    found, left = plan.first()["r"]
    assert left == 0 and sorted((x["k"], x["n"]) for x in found) == [(k, 1) for k in range(60)]


@pytest.mark.parametrize("retries", [1, 8])
def test_digests_of_equal_cells_are_recovered(spark, monkeypatch, retries):
    """With two cells a part, every eighth pair of a table shares all its cells."""
    monkeypatch.setattr(fingerprint, "THIRD", 2)
    monkeypatch.setattr(fingerprint, "RETRIES", retries)
    frame = spark.createDataFrame([(list(range(1500)), list(range(700, 2000)))], "a array<long>, b array<long>")
    tables = frame.withColumns({c: fingerprint.sketch(F.col(c[0])) for c in ("a_t", "b_t")})
    found = tables.select(
        fingerprint.differing(F.col("a"), F.col("b"), F.col("a_t"), F.col("b_t")).alias("d")
    ).first()["d"]["found"]
    want = {(k, 1) for k in range(700)} | {(k, -1) for k in range(1500, 2000)}
    assert len(found) == len(want) and {(x["k"], x["n"]) for x in found} == want


def test_licenses(odd):
    rows = licenses.scan(odd).collect()
    assert len(rows) == len(TEXTS)
    lower = str.maketrans(licenses.UPPER, licenses.LOWER)
    texts = {i: t or "" for i, t in TEXTS if i is not None}
    for r in rows:
        if r["doc_id"] is None:
            continue
        found = re.findall(licenses.WORD, texts[r["doc_id"]].translate(lower))
        at = [
            (k, label)
            for phrase, label in licenses.PHRASES.items()
            for k in range(len(found))
            if found[k : k + len(phrase.split())] == phrase.split()
        ]
        assert r["n_words"] == len(found) and r["n_base"] == len(at)
        assert r["first_word"] == min((k for k, _ in at), default=None)
        assert r["last_word"] == max((k for k, _ in at), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
    some = next(r for r in rows if r["doc_id"] == 20)
    assert some["labels"] == "apache,apache-2.0,gpl,mit" and some["score"] == 1.0


def test_notice_with_changed_words(spark):
    notice = next(t for t, label in licenses.NOTICES.items() if label == "mit-notice").split()
    changed = [*notice[:9], "new", *notice[9:20], *notice[21:]]
    docs = spark.createDataFrame([(1, " ".join(["lead"] * 7 + changed)), (2, " ".join(notice[:9]))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert found[1]["labels"] == "mit-notice" and 0.6 <= found[1]["score"] < 1
    assert found[2]["labels"] == "" and found[2]["score"] == 0


def test_packing(odd):
    pieces = packing.token_pieces(odd, BYTE, capacity=64, keep_ids=True)
    rows = packing.pack(pieces, capacity=64).collect()
    library = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        rest = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(rest, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, b"".join(x.to_bytes(4, "little") for x in ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    placed = {}
    for r in rows:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit(seed):
    import random

    some = random.Random(seed)
    capacity = some.choice([8, 30, 64])
    counts = {n: some.choice([1, 2, 10, 99]) for n in range(1, capacity + 1) if some.random() < 0.6}
    slots = packing.best_fit_plan(counts, capacity)
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r[0] >= length]
            if fits:
                min(fits)[0] -= length
            else:
                rooms.append([capacity - length])
    sequences = {first + k for _, a, b, first, _ in slots for k in range(b - a)}
    assert len(sequences) == len(rooms)
    ranks = Counter((length, k) for length, a, b, _, _ in slots for k in range(a, b))
    assert ranks == Counter((n, k) for n, many in counts.items() for k in range(many))


def test_chat_parts_and_escapes(spark):
    part = "type string, text string, ref string, width int, height int, seconds double, pages int"
    said = "<s> \\ <\\/s> [INST] <image> </s>\n</s>\n[/INST]"
    rows = [
        (1, 0, "user", [("text", said, *[None] * 5), ("image", None, "a.png", 28, 15, None, None)]),
        (1, 1, "assistant", [("text", said + "\\", *[None] * 5)]),
        (1, 2, "user", [("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3)]),
        (1, 3, "assistant", None), (None, None, None, [("text", None, *[None] * 5)]),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, p array<struct<{part.replace(' ', ':')}>>".replace(",:", ","))
    shaped = chat.format_chats(frame.withColumn("text", F.lit("x")), F.col("p"))
    read = {r["conv_id"]: r for r in chat.read_back(shaped).collect()}
    turns = [(t["role"], t["text"]) for t in read[1]["turns"]]
    assert turns == [("user", said + "<image>"), ("assistant", said + "\\"), ("user", "<audio><document>"), ("assistant", "")]
    assert read[1]["loss_text"] == said + "\\"
    assert [(t["role"], t["text"]) for t in read[None]["turns"]] == [("", "")]
    first = next(r for r in shaped.collect() if r["conv_id"] == 1)
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in first["attachments"]] == [
        (0, "image", "a.png", 4), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 768),
    ]
    masked = "".join(first["formatted"][m["start"] : m["start"] + m["length"]] for m in first["loss_mask"])
    assert masked.replace("<\\", "<").replace("[\\", "[").endswith("\\")


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_join_finds_all_links(spark, width, percent):
    import random

    some = random.Random(width)
    base = [[f"w{some.randrange(400)}" for _ in range(some.choice([30, 60, 200]))] for _ in range(12)]
    texts = [None, "", "a b", "A b", "a"]
    for words in base:
        for _ in range(12):
            copy = list(words)
            for _ in range(some.choice([0, 0, 1, 2, 4])):
                copy[some.randrange(len(copy))] = f"v{some.randrange(1000)}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts, start=10))
    docs = spark.createDataFrame([*rows, (None, texts[-1])], "doc_id long, text string").repartition(4)

    def grams(t):
        w = (t or "").lower().split()
        return frozenset(zip(*(w[i:] for i in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = {i: grams(t) for i, t in rows}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, width, percent).collect()}
    assert got.pop(None)[1] is None
    assert got == {i: (len(sets[i]), least[i]) for i in sets}
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs, width, percent).collect()}
    assert kept == {i for i in least if least[i] == i} | {None}


def test_one_row_of_each_class_under_repeated_ids(spark):
    """An id's copy says nothing of the id's other texts; one row of a class stays."""
    def said(x, tail=""):
        return " ".join(f"{x}{k}" for k in range(40)) + tail

    rows = [
        (3, said("a"), "p"), (7, said("a"), "p"), (7, said("b"), "p"),  # 7 copies 3, and has b alone
        (4, said("c"), "p"), (4, said("c"), "q"), (4, said("c").upper(), "p"), (9, said("c", " end"), "p"),
        (5, said("d"), "p"), (5, said("d"), "p"), (5, said("d", " end"), "p"), (2, said("e"), "p"), (2, said("f"), "p"),
        (8, "", "p"), (8, None, "p"), (None, said("e"), "p"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    left = Counter((r["doc_id"], (r["text"] or "").split(" ")[0].lower()) for r in kept.collect())
    assert left == Counter([(3, "a0"), (7, "b0"), (4, "c0"), (5, "d0"), (2, "e0"), (2, "f0"), (8, ""), (8, ""), (None, "e0")])


@pytest.mark.parametrize("small", [2, 1000])
def test_blocks_find_what_stars_miss(spark, monkeypatch, small):
    """Small blocks: chains of copies whose ends are too far from the first."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words[k:], *(f"n{j}" for j in range(k))]) for k in range(0, 60, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["component_id"] for r in ngram_join.join(docs, 3, 90).collect()}
    assert got == {0}


def test_warc_round_trip(spark, tmp_path):
    pages = [(3, "u3", "<p>é</p>"), (1, "u\r\n1", "<p>é</p>"), (2, None, None), (4, "u4", ""), (None, "x", "<p>é</p>"), (1, "v", "<p>é</p>")]
    frame = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, digest int, type string")
    folder = str(tmp_path / "archive")
    warc.write_archive(frame, folder)
    index = sorted(warc.read_index(spark, folder).collect(), key=lambda r: (r["page_id"] or 99, r["record_type"]))
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in index] == [
        (1, 9, "response", None), (1, 9, "revisit", 1), (2, 0, "response", None), (3, 9, "revisit", 1),
        (4, 0, "revisit", 2), (None, 9, "revisit", 1),
    ]
    import base64

    assert index[0]["payload_digest"] == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    records = [r for r in warc.read_records(spark, folder).collect() if r["type"] == "response"]
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block)
    assert any(bytes(r["record"]).endswith("<p>é</p>".encode()) for r in records)
    assert spark.read.parquet(f"{folder}/payloads").count() == 2
    small = str(tmp_path / "small")
    warc.write_archive(frame, small, min_bytes=10)
    assert {r["record_type"] for r in warc.read_index(spark, small).collect()} == {"response"}
    warc.write_archive(frame.limit(0), str(tmp_path / "none"))
    assert warc.read_index(spark, str(tmp_path / "none")).collect() == []


def test_bpe_equals_the_library(odd):
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(odd, WORD).collect()) == want
    decoded = bpe.decode(bpe.encode(odd, WORD), WORD).collect()
    assert Counter(hashlib.sha256(r["decoded"].encode()).hexdigest() for r in decoded) == Counter(
        {k[3]: 0 for k in want}
    ) + sum((Counter({k[3]: n}) for k, n in want.items()), Counter())


def test_counts_follow_edits(odd):
    edits = F.from_json(
        F.lit('[{"start":3,"delete":4,"insert":"\'re x"},{"start":-2,"delete":0},null,{"start":9999999,"delete":7,"insert":"  end"}]'),
        f"array<{token_counts.EDIT}>",
    )
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    want = Counter()
    for i, t in TEXTS:
        t = t or ""
        after = t[:3] + "'re x" + t[7:] + "  end" if len(t) >= 3 else t + "'re x" + "  end"
        want[i, *(len(library.encode(x, add_special_tokens=False).ids) for x in (t, after)), len(after)] += 1
    rows = token_counts.count_edited(odd, edits, BYTE).collect()
    assert Counter(tuple(r)[:4] for r in rows) == want
    assert max(r["encoded_again"] for r in rows if r["doc_id"] == 12) < 100


def test_quality_measures(odd):
    rows = quality.assess(odd).collect()
    assert len(rows) == len(TEXTS)
    texts = {i: t or "" for i, t in TEXTS if i is not None}
    for r in rows:
        if r["doc_id"] is None:
            continue
        text = texts[r["doc_id"]]
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(found[k : k + 8]) for k in range(len(found) - 7)]
        often = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["n_words"] == len(found) and r["word_chars"] == sum(map(len, found))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(found) < 20 or 100 * len(covered) > 30 * len(found))
        assert not (r["base_failed"] and r["kept"])
    kept = {(r["doc_id"], r["text"]) for r in quality.keep_good(odd).collect()}
    assert kept == {(r["doc_id"], texts[r["doc_id"]]) for r in rows if r["kept"]}


def test_votes_separate_good_from_bad():
    import random

    some = random.Random(1)
    rules = len(quality.RULES)
    patterns, truth = Counter(), {}
    for _ in range(5000):
        good = some.random() < 0.85
        wrong = 0.01 if good else 0.5
        pattern = tuple(0 if some.random() < 0.1 else (-1 if some.random() < wrong else 1) for _ in range(rules))
        patterns[pattern] += 1
        truth.setdefault(pattern, Counter())[good] += 1
    model = quality.fit_votes(patterns)
    assert 0.8 < model.good < 0.9
    assert all(x > 0.97 for x in model.right_on_good)
    assert quality.fit_votes({}).good > 0


def test_toxicity_held_out(spark):
    import random

    some = random.Random(5)
    syllables = "tion er the and re in he or an ly st ed wh sh ble".split()

    def text(toxic):
        words = ["".join(some.choices(syllables, k=some.randint(1, 3))) for _ in range(60)]
        if toxic:
            for _ in range(3):
                words[some.randrange(60)] = some.choice(["moronic", "scumbag", "vermins", "trashy"]) + some.choice(["", "ly", "s"])
        return " ".join(words)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(*r[:2], "x", 0.5) for r in rows] + [(None, None, "x", 0.5), (9001, "", "x", 0.5)], "doc_id long, text string, held_out string, score double")
    known = labels(spark, [(r[0], r[2]) for r in rows])
    scored = {r["doc_id"]: r for r in toxicity.score_documents(docs, known).collect()}
    held = [(scored[i]["predicted"], y) for i, _, y in rows if scored[i]["held_out"]]
    assert len(held) > 200
    assert sum(p == 1 for p, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(p == 1 for p, y in held if not y) <= 0.01 * len(held)
    assert scored[None]["predicted"] == scored[9001]["predicted"] == 0
    assert toxicity.drop_toxic(docs, known).columns == docs.columns
    none = toxicity.score_documents(docs, labels(spark, ())).collect()
    assert {r["score"] for r in none} == {0.0}


def test_toxicity_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    """An id that many rows hold."""
    taken = []
    monkeypatch.setattr(toxicity, "fit_texts", lambda rows: taken.append(rows))
    rows = [(7, f"text {i % 50} " + "é" * 40) for i in range(200)] + [(i, f"own {i} " + "b" * 80) for i in range(8, 40)]
    docs = spark.createDataFrame([*rows, (9, None), (None, "x")], "doc_id long, text string").repartition(4)
    known = labels(spark, [(i, int(i in (7, 38))) for i in range(7, 40)])
    toxicity.fit(docs, known, 10, 5)
    toxicity.fit(docs, known)
    toxicity.fit(docs, known, max_bytes=2000)
    assert Counter(y for _, y in taken[0]) == {1: 10, 0: 5}
    assert any(t.startswith("own 38 ") for t, _ in taken[0])
    assert len(taken[1]) == len(set(taken[1])) and {t for t, y in taken[1] if y} == {t for i, t in rows if i in (7, 38)}
    for label in (0, 1):
        assert 800 < sum(len(t.encode()) for t, y in taken[2] if y == label) <= 1000


def test_sql_of_chat_and_warc():
    for name in ("op4_chat_formatting", "op6_warc"):
        assert duckdb.extract_statements(SQL[name])


def test_stages_keep_clashing_names(spark):
    """Columns named like the operators' own, and names with dots, come through unchanged."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 77, 5, "x", 3), (2, text + " more", 78, 6, "y", 4), (3, "other " * 30, 79, 7, "z", 5)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, _join_id long, _join_digest long, `a.b` string, key int"
    )
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["_join_id"], r["_join_digest"], r["a.b"]) for r in kept.collect()} == {(1, 77, 5, "x"), (3, 79, 7, "z")}
    pieces = spark.createDataFrame(
        [(i, 0, 1 + i % 9, 7, 8, 9, 10, "p") for i in [*range(50), *([4] * 30)]],
        "doc_id long, piece int, length long, _salt int, offset int, first_sequence int, rank_from int, `a.b` string",
    )
    packed = packing.pack(pieces, 16)
    assert packed.columns == [c for c in pieces.columns if c != "offset"] + ["sequence_id", "offset"]
    got = packed.collect()
    assert {(r["_salt"], r["first_sequence"], r["rank_from"], r["a.b"]) for r in got} == {(7, 9, 10, "p")}
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    ends = {}
    for sequence, offset, length in spans:
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert len(got) == 80 and max(ends.values()) <= 16


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_tiles_hold_every_similar_pair(percent):
    """Sets at the very edge of the threshold share a tile, whichever way they differ."""
    import random

    import numpy as np

    drawn = random.Random(percent)
    sets, pairs = [], []
    for _ in range(300):
        n = drawn.choice([1, 2, 3, 5, 9, 20, 45, 130, 700])
        a = {drawn.getrandbits(63) - (1 << 62) for _ in range(n)}
        common = set(drawn.sample(sorted(a), drawn.randrange(max(0, n - n * (100 - percent) // 100), n + 1)))
        b = set(common)
        while 100 * len(common) >= percent * len(a | b | {0}) and drawn.random() < 0.97:
            b.add(drawn.getrandbits(63) - (1 << 62))
        if 100 * len(a & b) >= percent * len(a | b):
            pairs.append((len(sets), len(sets) + 1))
            sets += [np.array(sorted(x), np.int64) for x in (a, b)]
    place, tile = ngram_join.tiles_of(sets, percent)
    held = {}
    for i, t in zip(place.tolist(), tile.tolist()):
        held.setdefault(i, set()).add(t)
    assert len(pairs) > 100
    for i, j in pairs:
        assert np.array_equal(sets[i], sets[j]) or held.get(i, set()) & held.get(j, set())


def test_signatures_bound_from_above():
    import random

    import numpy as np

    drawn = random.Random(9)
    for percent in (80, 90):
        for n in (3, 40, 900):
            a = np.array(sorted(drawn.getrandbits(63) for _ in range(n)), np.int64)
            b = np.array(sorted([*a[n // 20 :].tolist(), *(drawn.getrandbits(63) for _ in range(n // 9))]), np.int64)
            x, y = (np.frombuffer(ngram_join.signature(s, percent), np.uint64) for s in (a, b))
            words = min(len(x), len(y))
            unlike = np.bitwise_count(ngram_join.folded(x, words) ^ ngram_join.folded(y, words)).sum()
            assert unlike <= len(set(a.tolist()) ^ set(b.tolist()))


def test_records_are_rebuilt_and_checked(spark, tmp_path, monkeypatch):
    """A payload that most records share, equal rows without id, revisits that are resolved."""
    monkeypatch.setattr(warc, "SHARED", 7)
    rows = [(i, f"u{i}", "<p>same</p>") for i in range(40)] + [(None, None, "<p>same</p>")] * 20 + [(99, "v", "é" * 50)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = str(tmp_path / "archive")
    warc.write_archive(frame, folder)
    index = warc.read_index(spark, folder).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in index) == Counter(
        [(0, "response", None), (99, "response", None)] + [(i, "revisit", 0) for i in range(1, 40)] + [(None, "revisit", 0)] * 20
    )
    assert {r["payload_bytes"] for r in index} == {11, 100}
    read = warc.read_records(spark, folder, resolve=True).collect()
    assert len(read) == 61 and {bytes(r["payload"]) for r in read} == {b"<p>same</p>", ("é" * 50).encode()}
    assert all(bytes(r["record"]).endswith(b"\r\n\r\n") == (r["type"] == "revisit") for r in read)
    names = [bytes(r["record"]).split(b"Record-ID: ")[1].split(b"\r\n")[0] for r in read]
    assert len(set(names)) == 61
    broken = spark.read.parquet(f"{folder}/records").withColumn(
        "header", F.regexp_replace("header", "Content-Length: 1", "Content-Length: 2")
    )
    broken.write.parquet(str(tmp_path / "other" / "records"))
    spark.read.parquet(f"{folder}/payloads").write.parquet(str(tmp_path / "other" / "payloads"))
    with pytest.raises(Exception, match="header differs"):
        warc.read_index(spark, str(tmp_path / "other")).collect()


def test_counting_goes_on_from_a_stored_tree(spark, tmp_path, monkeypatch):
    """The second round of edits starts from the first one's tree and encodes only its own."""
    texts = [(1, LONG), (2, "a b"), (3, None), (4, "x" * 5_000 + " tail it's"), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)

    def edits(start, delete, insert):
        kinds = f"array<{token_counts.EDIT}>"
        return F.array(F.struct(F.lit(start).alias("start"), F.lit(delete).alias("delete"), F.lit(insert).alias("insert"))).cast(kinds)

    token_counts.count_edited(docs, edits(2, 1, "new words"), BYTE, keep=True).write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    again = token_counts.count_edited(state, edits(7, 3, " and 42"), BYTE, tree_col="tree", keep=True)
    codec = Tokenizer.from_file(BYTE)
    for r in again.collect():
        text = dict(texts)[r["doc_id"]] or ""
        once = text[:2] + "new words" + text[3:]
        twice = once[:7] + " and 42" + once[10:]
        assert r["text"] == twice and r["edited_chars"] == len(twice)
        assert r["n_tokens"] == len(codec.encode(once, add_special_tokens=False).ids)
        assert r["edited_tokens"] == len(codec.encode(twice, add_special_tokens=False).ids)
        assert r["encoded_again"] < 100 or r["doc_id"] == 4
    wrong = state.withColumn("text", F.concat("text", F.lit(" longer")))
    for r in token_counts.count_edited(wrong, F.lit(None), BYTE, tree_col="tree").collect():
        text = dict(texts)[r["doc_id"]] or ""
        text = text[:2] + "new words" + text[3:] + " longer"
        assert r["n_tokens"] == len(codec.encode(text, add_special_tokens=False).ids)

    # a stored tree is not encoded at all
    counted = token_counts.CountedText(LONG, token_counts.counter(BYTE))
    monkeypatch.setattr(token_counts.Counter, "items", None)
    assert token_counts.CountedText(LONG, token_counts.counter(BYTE), counted.tree()).n_tokens == counted.n_tokens


def test_whole_licenses_are_found_with_changes(spark):
    """A license with its own copyright line, line breaks, and a word changed here and there."""
    by_label = {label: text.split() for text, label in licenses.LICENSES.items()}
    rows = []
    for i, (label, text) in enumerate(sorted(by_label.items())):
        changed = [("COPYING," if k % 25 == 24 else w.title()) + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(text)]
        rows.append((i, f"Copyright (c) 2020 Someone.\n{''.join(changed)}\nint main() {{}}", label))
        rows.append((10 + i, " ".join(text[: len(text) // 3]), None))  # a third is not the license
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    found = {r["doc_id"]: r for r in licenses.scan(docs.drop("label")).collect()}
    for i, _, label in rows:
        have = {x for x in found[i]["labels"].split(",") if x.endswith("-text")}
        assert have == ({label} if label else set()), (i, found[i]["labels"])
        assert found[i]["n_base"] == 0 and (label is None or 0.6 <= found[i]["score"] <= 1)


def test_texts_are_taken_in_pieces_of_bounded_size(spark):
    """Rows of an Arrow batch that are long make small pieces, and no row is lost."""
    sizes = [20_000] * 300 + [3_000_000, 0] + [1] * 5_000
    docs = spark.createDataFrame([("x" * n,) for n in sizes], "text string").coalesce(1)

    def step(piece):
        arrays = [[piece.num_rows], [sum(map(len, piece.column("text").to_pylist()))]]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["rows", "bytes"])

    found = ngram_join._batches(docs, step, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == len(sizes) and sum(r["bytes"] for r in found) == sum(sizes)
    assert all(r["rows"] == 1 or r["bytes"] <= 1 << 20 for r in found)


def test_scoring_leaves_nothing_in_workers(spark):
    """What a task remembers of words goes with it: its worker goes on to other stages."""
    rows = [(f"fine words {i} and more of them", 0) for i in range(40)]
    rows += [(f"awful dreadful{i} swearing", 1) for i in range(40)]
    model = toxicity.fit_texts(rows)
    frame = spark.createDataFrame([(t,) for t, _ in rows], "text string").coalesce(1)
    assert frame.select(toxicity.score(model, F.col("text")).alias("s")).filter("s is null").count() == 0

    def left(batches):
        import gc

        kept = sum(type(x).__name__ == "Gain" for x in gc.get_objects())
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([kept])], ["kept"])

    assert {r["kept"] for r in frame.mapInArrow(left, "kept long").collect()} == {0}
