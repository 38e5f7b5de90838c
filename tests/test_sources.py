"""Readers and writers."""

import os
import random

import pytest

from textprep import sources as src
from textprep.sources import idvalue
from textprep.sources.quoted import read_quoted
from textprep.operators.joins import join_labels
from textprep.functions import decode_label


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_quotes_breaks_missing_and_order(spark, tmp_path):
    pos = write(tmp_path / "pos.csv", 'username,text\na,"says ""hi"",\nthen goes"\nb,NA\nc,दो\n')
    neg = write(tmp_path / "neg.csv", "text,followers\nदो,3\nतीन,\n")
    df = src.read_labelled(spark, {1: pos, 0: neg})
    rows = df.orderBy("source_rank", "id").collect()
    assert [(r["text"], r["label"], r["source_rank"]) for r in rows] == [
        ('says "hi",\nthen goes', 1, 0), (None, 1, 0), ("दो", 1, 0), ("दो", 0, 1), ("तीन", 0, 1),
    ]
    assert rows[0]["followers"] is None and rows[3]["followers"] == "3"


def test_missing_text_column_fails_before_any_job(spark, tmp_path):
    path = write(tmp_path / "x.csv", "tweet\na\n")
    with pytest.raises(ValueError, match="text"):
        src.read_labelled(spark, {1: path})


def test_inline_rows(spark):
    df = src.inline_rows(spark, [("एक", 1), ("दो", 0)])
    assert df.dtypes == [("text", "string"), ("label", "int")] and df.count() == 2


def parse(text, skip_blank=True):
    """One pass over the lines."""
    current, out = "", {}
    for line in text.split("\n")[:-1]:
        line = line.strip()
        if line.isdigit():
            current = line
        elif current and (line or not skip_blank):
            out[current] = line
    return out


CASE = "orphan\n1\nfirst\n\n2\n\n3\nold\n1\nsecond\n१२\nhindi digits\n²\nsuper\n  7 \n padded \nlast\n"


@pytest.mark.parametrize("skip_blank", [True, False])
def test_id_value_cases(spark, tmp_path, skip_blank):
    path = write(tmp_path / "t.txt", CASE)
    rows = src.read_id_value_lines(spark, path, skip_blank).collect()
    assert {r["id"]: r["value"] for r in rows} == parse(CASE, skip_blank)


def test_id_value_over_many_splits(spark, tmp_path):
    """Splits far smaller than the file: ids carry over their edges."""
    text = "".join(
        f"{i}\n" + "".join(f"line {j} of {i}\n" for j in range(1 + 300 * (i % 50 == 0)))
        for i in range(2000)
    )
    path = write(tmp_path / "big.txt", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        rows = src.read_id_value_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["id"]: r["value"] for r in rows} == parse(text)


def test_id_value_join(spark, tmp_path):
    texts = src.read_id_value_lines(spark, write(tmp_path / "a.txt", "1\nx\n2\ny\n"))
    truth = src.read_id_value_lines(spark, write(tmp_path / "b.txt", "2\nYES\n3\nNO\n"))
    labels = truth.select("id", decode_label("value").alias("label"))
    rows = join_labels(texts, labels).collect()
    assert [tuple(r) for r in rows] == [("2", "y", 1)]


def test_vectors_round_trip(spark, tmp_path):
    words = [("क", [0.5, -1.0, 3e-05]), ("12", [1.0, 2.0, 3.0]), ("ख", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(words, "term string, vector array<float>")
    out = str(tmp_path / "v")
    src.write_vectors(df, out)
    parts = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    joined = "".join(open(os.path.join(out, p), encoding="utf-8").read() for p in parts)
    assert joined.split("\n")[0] == "3 3"
    back = {r["term"]: r["vector"] for r in src.read_vectors(spark, out).collect()}
    assert back == {r["term"]: r["vector"] for r in df.collect()}
    kept = src.limit_vectors(df, spark.createDataFrame([("क",), ("क",)], "term string"))
    assert [r["term"] for r in kept.collect()] == ["क"]


def test_report_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "class string, f1 double")
    for fmt in ("parquet", "csv"):
        src.write_report(df, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).collect() == df.collect()
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["class"] == "a"


def test_vectors_of_one_dimension_and_repeated_words(spark, tmp_path):
    out = str(tmp_path / "one")
    spark.createDataFrame([("7 1",), ("8 2",), ("8 3",)], "value string").coalesce(1).write.text(out)
    rows = src.read_vectors(spark, out, header=False)
    assert sorted((r["term"], r["vector"]) for r in rows.collect()) == [("7", [1.0]), ("8", [2.0]), ("8", [3.0])]
    kept = src.limit_vectors(rows, spark.createDataFrame([("8",)], "term string")).collect()
    assert [(r["term"], r["vector"]) for r in kept] == [("8", [3.0])]


@pytest.fixture
def small_splits(spark):
    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def csv_text(seed, rows, break_="\n"):
    """Rows with line breaks, commas and quotes in quotes; some odd ones; one long text."""
    drawn = random.Random(seed)

    def cell():
        kind = drawn.random()
        plain = drawn.choice(["", "a", "bc d", " x ", "दो", 'say 5" here', "NA", "3"])
        if kind < 0.5:
            return plain
        inner = "".join(drawn.choice(["a", "b ", ",", '""', break_, break_ + break_, "ए"]) for _ in range(drawn.randrange(12)))
        return f'"{inner}"' + ("tail" if kind > 0.97 and break_ == "\n" else "")

    lines = ["text,n,tag"]
    for i in range(rows):
        if i == rows // 2:
            lines.append('"' + break_.join(f"long ""line"" {j}, of many" for j in range(400)).replace('"', '""') + f'",{i},z')
        width = drawn.choice([3, 3, 3, 3, 2, 4])
        lines.append(",".join(cell() for _ in range(width)))
        if drawn.random() < 0.05:
            lines.append("")
    return break_.join(lines) + (break_ if seed % 2 else "")


def spark_csv(spark, path):
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return [tuple(r) for r in reader.csv(path).collect()]


@pytest.mark.parametrize("seed, size", [(0, 100), (1, 333), (2, 5_000), (3, 1_000_000)])
def test_quoted_breaks_are_read_by_many_tasks(spark, tmp_path, small_splits, seed, size):
    path = write(tmp_path / "big.csv", csv_text(seed, 300))
    want = spark_csv(spark, path)
    small_splits(size)
    schema = spark.read.option("header", True).option("multiLine", True).csv(path).schema
    found = read_quoted(spark, path, schema)
    assert size > 10_000 or found.rdd.getNumPartitions() > 5
    rows = sorted(found.collect(), key=lambda r: r["_reading_order"])
    assert [tuple(r)[:-1] for r in rows] == want
    assert len({r["_reading_order"] for r in rows}) == len(rows)


def test_quoted_breaks_in_several_files_and_with_carriage_returns(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    for seed in range(4):
        text = csv_text(seed, 60, "\r\n" if seed == 2 else "\n")
        (tmp_path / "in" / f"{seed}.csv").write_bytes(text.encode())
    want = sorted(x for s in range(4) for x in map(repr, spark_csv(spark, str(tmp_path / "in" / f"{s}.csv"))))
    small_splits(700)
    found = src.read_tweets(spark, str(tmp_path / "in"), missing=["\0"])
    assert found.columns == ["text", "n", "tag", "id"]
    assert sorted(repr(tuple(r)[:3]) for r in found.collect()) == want


def test_open_quote_at_the_end_and_empty_files(spark, tmp_path, small_splits):
    path = write(tmp_path / "open.csv", 'text,n\na,1\n"open\n' + "on and on\n" * 50)
    want = spark_csv(spark, path)
    small_splits(40)
    want = [(want[0]), (want[1][0].removesuffix("\n"), None)]  # the last line feed ends the line
    assert [tuple(r)[:2] for r in src.read_tweets(spark, path, missing=["\0"]).orderBy("id").collect()] == want
    assert src.read_tweets(spark, write(tmp_path / "head.csv", "text,n\n")).collect() == []


def test_header_has_to_agree_with_a_given_schema(spark, tmp_path):
    path = write(tmp_path / "x.csv", 'text,n\n"a\nb",1\n')
    read = src.read_tweets(spark, path, schema="text string, n int")
    assert [(r["text"], r["n"]) for r in read.collect()] == [("a\nb", 1)]
    with pytest.raises(Exception, match="header"):
        src.read_tweets(spark, path, schema="text string, m int").collect()


def test_no_text_of_records_crosses_an_exchange(spark, tmp_path):
    from test_scale import exchanged

    rows = src.read_id_value_lines(spark, write(tmp_path / "t.txt", CASE))
    assert "value" not in exchanged(rows)
    many = "".join(f"{i % 7}\nvalue {i}\n" for i in range(100))
    path = write(tmp_path / "many.txt", many)
    assert {r["id"]: r["value"] for r in src.read_id_value_lines(spark, path).collect()} == parse(many)


def test_many_repeated_ids_take_the_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idvalue, "REPEATED", 2)
    many = "".join(f"{i % 7}\nvalue {i}\n" for i in range(100)) + "9\nonce\n"
    rows = src.read_id_value_lines(spark, write(tmp_path / "many.txt", many))
    assert {r["id"]: r["value"] for r in rows.collect()} == parse(many)
