"""Plans and behaviour under skew: what must stay true when the tables grow."""

import re

import pytest
from pyspark.sql import functions as F

from textprep import functions as fn, session
from textprep.operators import dedup, joins, sampling, sequences, tfidf
from textprep.plans import conflict
from textprep.session import pin_small


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def skewed(spark):
    """One text holds a third of the rows."""
    text = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int")))
    return spark.range(60_000, numPartitions=8).select(
        "id", F.lit(0).alias("source_rank"), text.alias("text"),
        (F.col("id") % 2).cast("int").alias("label"),
    )


def test_keep_first_combines_before_the_shuffle(skewed):
    df = dedup.keep_first(skewed.select("id", "text", "label"), "text", "id")
    p = plan(df)
    assert p.count("Exchange") == 1 and "HashAggregate" in p and "SortAggregate" not in p
    assert "Window" not in p
    assert df.filter("text = 'hot'").first()["id"] == 0
    assert df.count() == skewed.select("text").distinct().count()


def test_profile_moves_no_text(skewed):
    p = plan(conflict.class_profile(skewed))
    assert "hashpartitioning(key" in p and "hashpartitioning(clean_text" not in p


@pytest.fixture
def shuffle_joins(spark):
    """Tables larger than any broadcast, except where the library asks for one."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "false",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def largest_task(df):
    """Share of all rows in the fullest partition."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_key_is_spread_in_the_lookups(skewed, shuffle_joins, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    members = dedup.duplicate_members(skewed, "text")
    assert members.filter("text = 'hot'").count() == 20_000
    counts = skewed.groupBy("text").count().filter("count > 1")
    assert members.count() == counts.agg(F.sum("count")).first()[0]
    assert largest_task(members) < 0.2  # a third would be 0.33 and more
    clean = dedup.drop_conflicts(skewed, "text")
    labels = skewed.groupBy("text").agg(F.count_distinct("label").alias("k"), F.count("*").alias("n"))
    assert clean.count() == labels.filter("k = 1").agg(F.sum("n")).first()[0]


def test_hot_term_is_spread_without_a_vocabulary_cap(spark, shuffle_joins, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    docs = spark.range(30_000, numPartitions=8).select(
        "id", F.array(F.lit("hot"), F.concat(F.lit("t"), F.col("id") % 97)).alias("t")
    )
    counts = tfidf.term_counts(docs, "t", ["id"])
    vocab = tfidf.term_stats(counts)
    looked_up = joins.lookup_terms(counts, vocab, ["df"], [F.desc("df")], None)
    assert looked_up.count() == 60_000 and looked_up.filter("df is null").count() == 0
    assert largest_task(looked_up) < 0.2
    assert tfidf.tfidf_weights(counts, vocab, 30_000, ["id"]).count() == 60_000


def test_capped_vocabulary_is_broadcast(spark):
    docs = spark.createDataFrame([(1, ["a", "b"])], "id int, t array<string>")
    vocab = sequences.fit_vocabulary(docs, "t", 10)
    p = plan(sequences.encode(docs, "t", vocab, ["id"], 10))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def exchanged(df):
    """Columns that the exchanges of the plan take in."""
    text = df._jdf.queryExecution().explainString(
        spark_mode(df.sparkSession)
    )
    found = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
    return {re.sub(r"#\d+L?", "", c) for columns in found for c in columns.split(", ")}


def spark_mode(spark):
    return getattr(spark._jvm.org.apache.spark.sql.execution, "ExplainMode").fromString("formatted")


def test_no_token_occurrence_crosses_an_exchange(spark, shuffle_joins, monkeypatch):
    """A document of one word 50,000 times sends one row to the vocabulary, as a list of places."""
    monkeypatch.setattr(joins, "HOT_KEYS", 1)
    docs = spark.createDataFrame(
        [(1, ["x"] * 50_000), (2, ["y", "x", "y"])], "id int, t array<string>"
    )
    vocab = sequences.fit_vocabulary(docs, "t")
    words = docs.select("id", F.inline_outer(sequences.word_places("t")))
    assert words.count() == 3
    coded = sequences.encode(docs, "t", vocab, ["id"])
    crossed = exchanged(coded)
    assert crossed and not crossed & {"t", "pos", "col"}
    assert {"term", "at"} <= crossed
    assert {r["id"]: (len(r["seq"]), r["seq"][:3]) for r in coded.collect()} == {1: (50_000, [1, 1, 1]), 2: (3, [2, 1, 2])}


def test_weights_need_no_exchange(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "id int, t array<string>")
    vocab = tfidf.term_stats(tfidf.term_counts(docs, "t", ["id"]))
    weighed = tfidf.weigh_documents(docs, "t", vocab, 2, ["id"], 10)
    assert "Exchange" not in plan(weighed) and weighed.count() == 3


def shuffled_bytes(plan):
    """What the exchanges of an executed plan wrote."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled_bytes(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled_bytes(plan.plan())
    own = plan.metrics().get("shuffleBytesWritten").get().value() if name == "ShuffleExchangeExec" else 0
    kids = plan.children()
    return own + sum(shuffled_bytes(kids.apply(i)) for i in range(kids.size()))


def test_sketch_halves_the_shuffle_of_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    docs = docs.repartition(8).cache()
    docs.count()
    tokens = fn.with_bigrams(fn.word_tokens("text"))

    def moved(df):
        df.collect()
        return shuffled_bytes(df._jdf.queryExecution().executedPlan())

    plain = moved(tfidf.df_bounds(tfidf.term_stats(tfidf.term_counts(docs, tokens, [])), 1_000, 7, 0.75))
    first = moved(tfidf.sketch(docs, tokens, 7))
    second = moved(tfidf.bounded_terms(docs, tokens, 1_000, 7, 0.75))
    assert 0 < first + second < plain / 2


def test_term_counts_need_no_exchange(spark):
    docs = spark.createDataFrame([(1, "a b a")], "id int, text string")
    counts = tfidf.term_counts(docs, fn.with_bigrams(fn.word_tokens("text")), ["id"])
    assert "Exchange" not in plan(counts)


def test_assigning_splits_and_folds_needs_no_exchange(skewed):
    for df in (
        sampling.stratified_split(skewed, 0.2, 1),
        sampling.stratified_folds(skewed, 5, 1),
        sampling.undersample(skewed, 1),
    ):
        p = plan(df)
        assert "hashpartitioning" not in p and "Window" not in p and "Sort" not in p


def test_scans_read_the_columns_they_need(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label")
    )
    p = plan(conflict.class_profile(texts.select("id", "text", "lang"), labels))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    assert "ReadSchema: struct<doc_id:bigint,toxic:int>" in p


def test_pin_small_keeps_large_tables_distributed(spark, monkeypatch):
    assert pin_small(spark.range(100), 99).count() == 100
    big, small = spark.range(100), spark.range(100)
    assert pin_small(big, 99) is big
    assert pin_small(small, 100) is not small
    monkeypatch.setattr(session, "PINNED_BYTES", 100)
    assert pin_small(small, 100) is small
