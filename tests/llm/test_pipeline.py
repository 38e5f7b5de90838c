"""The whole pipeline on planted documents, against a plain composition of its stages."""

import random
import re
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

INSULTS = "gribblehead snorvax plonkmuppet dwezzle krankwort zoltbrain".split()


def prose(drawn, n, words):
    out = [drawn.choice(words) for _ in range(n)]
    for i in range(9, n, 10):
        out[i] += "."
    return " ".join(out)


def planted():
    """``(id, text, kind)``: clean, toxic and poor ones, and copies of clean ones."""
    drawn = random.Random(11)
    words = ["".join(drawn.choice(["ta", "ri", "mo", "le", "sun", "der", "ka", "vi"]) for _ in range(drawn.choice([1, 2, 2, 3]))) for _ in range(500)]
    rows = [(i, prose(drawn, drawn.randrange(110, 200), words), "clean") for i in range(220)]
    for i in range(300, 400):
        text = prose(drawn, 120, words).split(" ")
        for _ in range(10):
            text[drawn.randrange(len(text))] = drawn.choice(INSULTS)
        rows.append((i, " ".join(text), "toxic"))
    rows += [(i, prose(drawn, 12, words), "poor") for i in range(400, 420)]
    rows += [(i, " ".join(prose(drawn, 8, words) for _ in [0]) + (" " + prose(random.Random(3), 8, words)) * 12, "poor") for i in range(420, 440)]
    for i in range(500, 530):  # exact copies
        rows.append((i, rows[i - 500][1], "copy"))
    for i in range(530, 560):  # copies with a word changed
        text = rows[i - 530][1].split(" ")
        text[60] = f"other{i}"
        rows.append((i, " ".join(text), "copy"))
    return rows


def one_of_each(texts):
    """The smallest id of every class of links, by comparing all pairs."""
    grams = {}
    for i, t in texts.items():
        w = t.lower().split()
        grams[i] = frozenset(zip(*(w[k:] for k in range(5))))
    least = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                both = len(grams[a] & grams[b])
                if both and 100 * both >= 80 * len(grams[a] | grams[b]) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return {i for i in texts if least[i] == i}


def test_pipeline_is_the_plain_composition(spark, tmp_path):
    rows = planted()
    sf = str(tmp_path)
    docs = spark.createDataFrame(
        [(i, t, "en", f"src{i % 3}", len(t)) for i, t, _ in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs.repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(
        [(i, 1, int(kind == "toxic")) for i, _, kind in rows], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{sf}/labels.parquet")

    texts = {i: t for i, t, kind in rows if kind != "toxic"}
    good = {i: t for i, t in texts.items() if len(t.split()) >= 20 and i not in range(420, 440)}
    assert len(good) == len(texts) - 40
    want = one_of_each(good)
    assert want == set(range(220))

    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == want
    codec = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = defaultdict(int)
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: len(codec.encode(texts[i], add_special_tokens=False).ids) + 1 for i in want}
    spans = defaultdict(list)
    for r in packed:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    rooms = []
    for length in sorted((r["length"] for r in packed), reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        best = min(fits, key=rooms.__getitem__, default=None)
        if best is None:
            rooms.append(1024 - length)
        else:
            rooms[best] -= length
    assert len(spans) == len(rooms)
    assert not re.search("|".join(INSULTS), " ".join(texts[i] for i in want))
