"""Queries over the driver tables, one per operator, and the SQL each must agree with."""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from oracle import DEVA_FROM, DEVA_TO  # noqa: E402
from textprep import functions as fn, sources as src  # noqa: E402
from textprep.functions import LATIN  # noqa: E402
from textprep.models import (  # noqa: E402
    Vocabulary,
    best_parameters,
    cooccurrence_vectors,
    mean_vectors,
    sample_rows,
    score_batches,
    weighted_logistic,
)
from textprep.operators import (  # noqa: E402
    dedup,
    evaluate,
    joins,
    profile,
    rows,
    sampling,
    sequences,
    tfidf,
    weights,
)
from textprep.plans import classical, conflict, sequence  # noqa: E402
from textprep.session import shared_folder, stable  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def register(name: str, f: Query) -> None:
    QUERIES[name] = f


# ---- bindings to the driver tables ------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return src.read_table(spark, f"{sf}/documents.parquet", "doc_id")


def tweet() -> Column:
    """A document as a tweet in Devanagari: mention, hashtag, text, links."""

    def deva(c: Column) -> Column:
        return F.translate(F.lower(c), DEVA_FROM, DEVA_TO)

    return F.concat(
        F.lit("@"), deva(F.col("source")), F.lit(" #"), deva(F.col("lang")), F.lit(" "),
        deva(F.col("text")), F.lit(" http://"), "lang", F.lit(".example/"), "doc_id",
        F.lit("!!?? www."), "source", F.lit(".example "), deva(F.col("source")),
    )


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tweet().alias("text"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, text, label, quality, source_rank)``: labelled documents, positives ranked first."""
    return (
        documents(spark, sf)
        .join(table(spark, sf, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            "text",
            F.col("toxic").alias("label"),
            "quality",
            F.when(F.col("toxic") == 1, 0).otherwise(1).alias("source_rank"),
        )
    )


def order() -> Column:
    return fn.row_order("source_rank", "id")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``quality`` stands in for a prediction of ``toxic``."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label"),
        F.col("quality").alias("prediction"),
    )


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def spaced(c: Column | str) -> Column:
    return F.array_join(c, " ")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- text functions ---------------------------------------------------------------


def pages_text() -> Column:
    return F.concat_ws(" ", "url", "html")


def on_pages(f: Callable[[Column], Column]) -> Query:
    return lambda spark, sf: src.read_table(spark, f"{sf}/pages.parquet", "page_id").select(
        "page_id", f(pages_text()).alias("result")
    )


def on_tweets(f: Callable[[Column], Column]) -> Query:
    return lambda spark, sf: tweets(spark, sf).select("doc_id", f(F.col("text")).alias("result"))


def on_documents(f: Callable[[Column], Column]) -> Query:
    return lambda spark, sf: documents(spark, sf).select(
        "doc_id", f(F.col("text")).alias("result")
    )


register("strip_url_narrow", on_pages(fn.strip_url))
register("strip_url_wide", on_pages(lambda c: fn.strip_url(c, wide=True)))
for _marks in ("strip", "keep"):
    register(f"strip_mention_{_marks}", on_tweets(lambda c, m=_marks: fn.strip_mention(c, m)))
    register(f"hashtag_drop_{_marks}", on_tweets(lambda c, m=_marks: fn.drop_hashtag(c, m)))
    register(f"hashtag_unwrap_{_marks}", on_tweets(lambda c, m=_marks: fn.unwrap_hashtag(c, m)))
    register(f"strip_social_{_marks}", on_tweets(lambda c, m=_marks: fn.strip_social(c, m)))
    register(f"keep_words_{_marks}", on_tweets(lambda c, m=_marks: fn.keep_words(c, m)))
    register(
        f"keep_words_punct_{_marks}", on_tweets(lambda c, m=_marks: fn.keep_words(c, m, "!?"))
    )
    for _name, _clean in fn.CLEANERS.items():
        register(
            f"clean_{_name}_{_marks}",
            on_tweets(lambda c, f=_clean, m=_marks: f(c, marks=m)),
        )
register(
    "clean_word_basic_documents", on_documents(lambda c: fn.word_basic(c, marks="strip"))
)
register(
    "clean_punct_lower_documents", on_documents(lambda c: fn.punct_lower(c, marks="strip"))
)
register(
    "clean_script_strict_latin",
    on_documents(lambda c: fn.script_strict(c, marks="strip", scripts=(LATIN,))),
)
register("script_filter_quotes", on_tweets(lambda c: fn.keep_script(c, extra='!?,.;:"')))
register("script_filter_letters", on_tweets(lambda c: fn.keep_script(c, extra="!?.,:;", letters=True)))
register("script_filter_only", on_tweets(lambda c: fn.keep_script(c, extra="!?.,:;")))
register("collapse_repeats", on_documents(fn.collapse_repeats))
register("collapse_space", on_pages(fn.collapse_space))
register("lower_case", on_documents(fn.lower_case))
register("split_space", on_pages(lambda c: F.array_join(fn.split_space(c), "|")))

# ---- rows, labels, union ----------------------------------------------------------


@query
def required_columns(spark: SparkSession, sf: str) -> DataFrame:
    return src.require_columns(documents(spark, sf), ["doc_id", "text"]).select("doc_id", "text")


@query
def label_union(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("text", "lang")
    talk = table(spark, sf, "conversations").select("text", "role")
    return src.union_labelled([(docs, "document"), (talk, "conversation")]).select(
        "text", "lang", "role", "label", "source_rank"
    )


@query
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rows.drop_if_present(documents(spark, sf), ["lang", "source", "retweetcount"])


@query
def stable_row_id(spark: SparkSession, sf: str) -> DataFrame:
    keyed = rows.with_row_id(documents(spark, sf).select("doc_id"), rank=3)
    return keyed.groupBy("source_rank").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_ids")
    )


@query
def drop_null_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", F.nullif("lang", F.lit("de")).alias("text"))
    return rows.drop_null(docs)


@query
def drop_blank(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that keep something once all of ASCII goes."""
    left = fn.collapse_space(F.regexp_replace(F.lower("text"), r"[\x00-\x7F]+", " "))
    return rows.drop_blank(documents(spark, sf).select("doc_id", left.alias("clean_text")))


@query
def min_length(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", fn.word_basic("text", "strip").alias("clean_text"))
    return rows.min_length(docs, length=500)


@query
def cast_text(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", fn.as_text(F.nullif("n_chars", F.length("text").cast("bigint"))).alias("a"),
        fn.as_text("n_chars").alias("b"),
    )


@query
def decode_label(spark: SparkSession, sf: str) -> DataFrame:
    word = F.when(F.col("toxic") == 1, "YES").when(F.col("quality") == 1, "NO").otherwise("yes")
    return table(spark, sf, "labels").select("doc_id", fn.decode_label(word).alias("label"))


@query
def select_text_label(spark: SparkSession, sf: str) -> DataFrame:
    rows_in = labelled(spark, sf).withColumn("clean_text", fn.word_basic("text", "strip"))
    return rows.select_xy(rows_in)


@query
def threshold_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", fn.threshold(F.col("value") / 100.0).alias("prediction")
    )


@query
def index_to_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        "doc_id", fn.index_to_label("toxic", ["clean", "toxic"]).alias("name")
    )


# ---- sources and sinks ------------------------------------------------------------


@query
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV file set per class, written and read back; texts hold quotes and line breaks."""
    out = fresh_folder(spark, "csv")
    rows_in = labelled(spark, sf).select("label", F.col("id").alias("tweet_id"), "text")
    for label in (1, 0):
        (
            rows_in.filter(F.col("label") == label)
            .drop("label")
            .write.option("header", True)
            .option("escape", '"')
            .option("quoteAll", True)
            .csv(f"{out}/{label}")
        )
    back = src.read_labelled(spark, {1: f"{out}/1", 0: f"{out}/0"})
    return back.select("tweet_id", "text", "label", "source_rank")


@query
def id_value_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and labels as two-line records, read back and joined on the id."""
    out = fresh_folder(spark, "lines")
    line = F.concat(F.lit("> "), F.regexp_replace("text", r"[\r\n]+", " "))
    rows_in = labelled(spark, sf)
    record = "concat_ws('\n', id, {0})".replace("\n", "\\n")
    rows_in.withColumn("line", line).select(F.expr(record.format("line"))).write.text(f"{out}/texts")
    rows_in.withColumn("word", F.when(F.col("label") == 1, "YES").otherwise("NO")).select(
        F.expr(record.format("word"))
    ).write.text(f"{out}/truth")
    texts = src.read_id_value_lines(spark, f"{out}/texts").withColumnRenamed("value", "text")
    truth = src.read_id_value_lines(spark, f"{out}/truth").select(
        "id", fn.decode_label("value").alias("label")
    )
    return joins.join_labels(texts, truth)


@query
def vector_file(spark: SparkSession, sf: str) -> DataFrame:
    """Word vectors written in the text layout and read back."""
    out = fresh_folder(spark, "vectors")
    words = table(spark, sf, "embeddings").select(
        F.concat(F.lit("w"), "vec_id").alias("term"), F.col("embedding").alias("vector")
    )
    src.write_vectors(words, out)
    return vector_summary(src.read_vectors(spark, out), "term")


@query
def report_sink(spark: SparkSession, sf: str) -> DataFrame:
    out = fresh_folder(spark, "report")
    src.write_report(class_report_full(spark, sf), out)
    return spark.read.parquet(out)


# ---- dedup, conflicts, joins ------------------------------------------------------


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).withColumn("clean_text", fn.word_basic("text", "strip"))


def by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents labelled by their source, whose copies in other sources contradict."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("label"),
        F.when(F.col("lang") == "en", 0).otherwise(1).alias("source_rank"),
    )


def sourced(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the whole cleaned text as key."""
    return by_source(spark, sf).select(
        fn.word_basic("text", "strip").alias("key"), "id", "label", "source_rank"
    )


@query
def dedup_raw_first(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keep_first(documents(spark, sf).select("doc_id", "text", "lang"), "text", "doc_id")


@query
def dedup_clean_first(spark: SparkSession, sf: str) -> DataFrame:
    rows_in = cleaned(spark, sf).select("id", "source_rank", "clean_text", "label")
    return dedup.keep_first(rows_in, "clean_text", order())


@query
def dedup_source_first(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keep_first(sourced(spark, sf), "key", ("source_rank", "id"))


@query
def duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", fn.word_basic("text", "strip").alias("clean_text"))
    return dedup.duplicate_members(docs, "clean_text")


@query
def duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", fn.word_basic("text", "strip").alias("clean_text"))
    return dedup.count_duplicate_members(docs, "clean_text")


@query
def conflict_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.conflict_groups(sourced(spark, sf), "key")


@query
def conflict_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.drop_conflicts(sourced(spark, sf), "key")


@query
def conflict_removed(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.resolve(sourced(spark, sf), "key", order=order())


@query
def conflict_removed_text(spark: SparkSession, sf: str) -> DataFrame:
    return conflict.prepare(by_source(spark, sf), marks="strip", min_chars=300, order=order())


def prepared(name: str, settings: sequence.SequenceSettings) -> None:
    """Documents in Devanagari, prepared for one of the sequence models."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        deva = F.translate(F.lower("text"), DEVA_FROM, DEVA_TO)
        return sequence.prepare(
            by_source(spark, sf).withColumn("text", deva), settings, order=order()
        )

    register(name, run)


prepared("prepare_gru", sequence.GRU)
prepared("prepare_lstm", sequence.LSTM)
prepared("prepare_vector_lstm", sequence.VECTOR_LSTM)
prepared("prepare_vector_gru", sequence.VECTOR_GRU)
prepared("prepare_frozen_lstm", sequence.FROZEN_LSTM)


@query
def vocab_distinct(spark: SparkSession, sf: str) -> DataFrame:
    clean = documents(spark, sf).select(fn.word_basic("text", "strip").alias("clean_text"))
    return dedup.distinct_terms(clean, fn.split_space("clean_text"))


@query
def label_join(spark: SparkSession, sf: str) -> DataFrame:
    texts = documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label")
    )
    return joins.join_labels(texts, labels)


# ---- class profile ----------------------------------------------------------------


@query
def row_count(spark: SparkSession, sf: str) -> DataFrame:
    return profile.row_count(documents(spark, sf))


@query
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_counts(table(spark, sf, "events"), "event_type")


@query
def class_share(spark: SparkSession, sf: str) -> DataFrame:
    shares = profile.class_shares(table(spark, sf, "conversations"), "role")
    return shares.withColumn("share", r6("share"))


@query
def class_share_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Class shares after cleaning, length filter, conflict removal and dedup."""
    texts = documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    shares = conflict.class_profile(
        texts, plain_labels(spark, sf), marks="strip", min_chars=300
    )
    return shares.withColumn("share", r6("share"))


@query
def class_dense_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Labels 0, 2 and 3 occur; 1 must show as zero."""
    sparse = table(spark, sf, "labels").select(
        (F.col("quality") * 2 + F.col("quality") * F.col("toxic")).alias("label")
    )
    return profile.dense_counts(sparse)


@query
def positive_ratio(spark: SparkSession, sf: str) -> DataFrame:
    ratio = profile.positive_ratio(table(spark, sf, "labels"), "toxic")
    return ratio.withColumn("ratio", r6("ratio"))


@query
def distinct_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_per_group(sourced(spark, sf), "key", "label")


@query
def min_class_size(spark: SparkSession, sf: str) -> DataFrame:
    return profile.min_class_size(table(spark, sf, "labels"), "toxic")


@query
def count_class(spark: SparkSession, sf: str) -> DataFrame:
    return profile.count_class(table(spark, sf, "labels"), 0, "toxic")


@query
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_labels(table(spark, sf, "events"), "event_type")


# ---- split, sampling, folds -------------------------------------------------------


def plain_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label")
    )


def event_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("label")
    )


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_split(plain_labels(spark, sf), 0.2, 42)


@query
def stratified_split_events(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_split(event_classes(spark, sf), 0.3, 91)


@query
def undersample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.undersample(plain_labels(spark, sf), 42)


@query
def undersample_events(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.undersample(event_classes(spark, sf), 7)


@query
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_folds(plain_labels(spark, sf), 5, 42)


# ---- sequences and vectors --------------------------------------------------------

NUM_WORDS = 800


def split_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled texts with their split."""
    return sampling.stratified_split(
        labelled(spark, sf).select("id", "text", "label"), 0.2, 42
    )


def vocabulary(spark: SparkSession, sf: str, num_words: int | None, oov: bool) -> DataFrame:
    """Fitted on the train part only."""
    train = split_texts(spark, sf).filter("split = 'train'")
    return sequences.fit_vocabulary(train, fn.sequence_tokens("text"), num_words, oov)


def encoded(spark: SparkSession, sf: str, oov: bool) -> DataFrame:
    vocab = vocabulary(spark, sf, NUM_WORDS, oov)
    return sequences.encode(
        labelled(spark, sf), fn.sequence_tokens("text"), vocab, ["id"], NUM_WORDS, oov
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``(term, vector)``: vocabulary word number ``vec_id + 1`` owns that vector."""
    words = vocabulary(spark, sf, None, False).select("idx", "term")
    table_in = table(spark, sf, "embeddings")
    return table_in.join(words, table_in["vec_id"] + 1 == words["idx"]).select(
        "term", F.col("embedding").alias("vector")
    )


def vector_summary(df: DataFrame, *keys: str) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return df.select(
        *keys,
        big(F.size("vector")).alias("dim"),
        F.round(total, 4).alias("total"),
        F.round(F.element_at("vector", -1).cast("double"), 5).alias("last_value"),
    )


@query
def vocab_fit(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary(spark, sf, NUM_WORDS, False)


@query
def vocab_fit_oov(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary(spark, sf, NUM_WORDS, True)


@query
def vocab_fit_full(spark: SparkSession, sf: str) -> DataFrame:
    """Every word ranked, by a distributed sort."""
    return sequences.fit_vocabulary(documents(spark, sf), fn.sequence_tokens("text"))


@query
def token_lookup(spark: SparkSession, sf: str) -> DataFrame:
    vocab = vocabulary(spark, sf, NUM_WORDS, False)
    found = sequences.lookup_ids(
        labelled(spark, sf), fn.sequence_tokens("text"), vocab, ["id"], NUM_WORDS
    )
    return found.select("id", big("pos").alias("pos"), "term", "idx")


@query
def seq_encode(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf, False).select("id", spaced("seq").alias("seq"))


@query
def seq_encode_oov(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf, True).select("id", spaced("seq").alias("seq"))


@query
def seq_encode_full(spark: SparkSession, sf: str) -> DataFrame:
    """All documents by the ids of all their words, whose vocabulary no task holds."""
    docs = documents(spark, sf)
    vocab = sequences.fit_vocabulary(docs, fn.sequence_tokens("text"))
    found = sequences.encode(docs, fn.sequence_tokens("text"), vocab, ["doc_id"])
    return found.select("doc_id", spaced("seq").alias("seq"))


def padded(name: str, length: int, padding: str, truncating: str, oov: bool) -> None:
    register(
        name,
        lambda spark, sf: encoded(spark, sf, oov).select(
            "id", spaced(sequences.pad("seq", length, padding, truncating)).alias("seq")
        ),
    )


padded("pad_post_trunc_pre", 35, "post", "pre", True)
padded("pad_post_trunc_post", 100, "post", "post", False)
padded("pad_pre_trunc_pre", 64, "pre", "pre", False)


@query
def vocab_model_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted vocabulary stage applied to all rows, without a join."""
    data = split_texts(spark, sf).withColumn("tokens", fn.sequence_tokens("text"))
    model = Vocabulary(numWords=NUM_WORDS, oov=True).fit(data.filter("split = 'train'"))
    return model.transform(data).select("id", spaced("seq").alias("seq"))


@query
def vector_table(spark: SparkSession, sf: str) -> DataFrame:
    vocab = vocabulary(spark, sf, NUM_WORDS, False)
    found = sequences.embedding_table(vocab, vectors(spark, sf), 64, NUM_WORDS)
    return vector_summary(found, "idx", "term")


@query
def vector_table_full(spark: SparkSession, sf: str) -> DataFrame:
    vocab = vocabulary(spark, sf, None, False)
    return vector_summary(
        sequences.embedding_table(vocab, vectors(spark, sf), 64), "idx", "term"
    )


@query
def vector_missing_normal(spark: SparkSession, sf: str) -> DataFrame:
    vocab = vocabulary(spark, sf, NUM_WORDS, False)
    found = sequences.embedding_table(
        vocab, vectors(spark, sf), 64, NUM_WORDS, missing="normal"
    )
    return vector_summary(found, "idx", "term")


@query
def vector_limited(spark: SparkSession, sf: str) -> DataFrame:
    """Undersampled documents, their words, the vectors of these words written and read back.

    The vector table belongs to the words of all documents and of words that none holds.
    """
    prepared = sampling.undersample(labelled(spark, sf).select("id", "text", "label"), 42)
    words = dedup.distinct_terms(prepared, fn.sequence_tokens("text"))
    known = sequences.fit_vocabulary(documents(spark, sf), fn.sequence_tokens("text"))
    named = table(spark, sf, "embeddings").join(
        known, F.col("vec_id") + 1 == F.col("idx"), "left"
    ).select(
        F.explode(F.array(F.col("term"), F.concat(F.lit("none"), "vec_id"))).alias("term"),
        F.col("embedding").alias("vector"),
    ).filter("term is not null")
    out = fresh_folder(spark, "limited")
    src.write_vectors(src.limit_vectors(named, words), out)
    return vector_summary(src.read_vectors(spark, out), "term")


@query
def vector_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.vector_dimension(
        table(spark, sf, "embeddings").select(F.col("embedding").alias("vector"))
    )


@query
def vector_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean word vector per document, as the sum and last component of it."""
    from pyspark.ml.functions import vector_to_array

    means = mean_vectors(
        labelled(spark, sf), fn.sequence_tokens("text"), vectors(spark, sf), ["id"], 64, 20_000
    )
    values = vector_to_array("features")
    return means.select(
        "id",
        r6(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)).alias("total"),
        r6(F.element_at(values, -1)).alias("last_value"),
    )


# ---- TF-IDF and selection ---------------------------------------------------------

FEATURES = classical.SVM_FEATURES


def terms(marks: str = "strip") -> Column:
    return fn.with_bigrams(fn.word_tokens("text", marks))


def counted(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.term_counts(labelled(spark, sf), terms(), ["id", "label"])


def bounded_stats(spark: SparkSession, sf: str) -> DataFrame:
    total = tfidf.document_total(table(spark, sf, "labels"))
    return tfidf.bounded_terms(
        labelled(spark, sf), terms(), total, FEATURES.min_df, FEATURES.max_df
    )


def capped(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.cap_vocabulary(bounded_stats(spark, sf), FEATURES.max_features)


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    total = tfidf.document_total(table(spark, sf, "labels"))
    return tfidf.weigh_documents(
        labelled(spark, sf), terms(), capped(spark, sf), total, ["id", "label"], FEATURES.max_features
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    sizes = sampling.class_sizes(plain_labels(spark, sf))
    return tfidf.chi2_scores(weighted(spark, sf), sizes)


for _marks in ("strip", "keep"):
    register(
        f"tfidf_tokens_{_marks}",
        lambda spark, sf, m=_marks: tweets(spark, sf).select(
            "doc_id", spaced(fn.word_tokens("text", m)).alias("tokens")
        ),
    )


@query
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(terms(), "|").alias("grams"))


@query
def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.term_counts(documents(spark, sf), terms(), ["doc_id"])


@query
def df_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return bounded_stats(spark, sf)


@query
def vocab_cap(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.cap_vocabulary(bounded_stats(spark, sf), 1_000)


@query
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return weighted(spark, sf).select("id", "term", r6("weight").alias("weight"))


@query
def chi2_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("term", r6("chi2").alias("chi2"))


@query
def chi2_topk(spark: SparkSession, sf: str) -> DataFrame:
    best = tfidf.select_k_best(scores(spark, sf), FEATURES.k)
    return best.select("term", r6("chi2").alias("chi2"))


@query
def chi2_projected(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the selected terms."""
    found = weighted(spark, sf)
    sizes = sampling.class_sizes(plain_labels(spark, sf))
    best = tfidf.select_k_best(tfidf.chi2_scores(found, sizes), FEATURES.k)
    kept = tfidf.project_terms(found, best, FEATURES.k)
    return kept.select("id", "term", r6("weight").alias("weight"))


@query
def tfidf_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The same weights from the fitted vector stages: entries and sum per document."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    stages = classical.feature_stages(FEATURES, "text", marks="strip")[:2]
    data = labelled(spark, sf).select("id", "text")
    found = Pipeline(stages=stages).fit(data).transform(data)
    values = F.filter(vector_to_array("tfidf"), lambda x: x > 0)
    return found.select(
        "id",
        big(F.size(values)).alias("n_terms"),
        r6(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)).alias("total"),
    )


# ---- weights and evaluation -------------------------------------------------------


@query
def weights_balanced(spark: SparkSession, sf: str) -> DataFrame:
    found = weights.balanced_weights(table(spark, sf, "events"), "event_type")
    return found.select("event_type", "n", r6("weight").alias("weight"))


@query
def weights_scaled(spark: SparkSession, sf: str) -> DataFrame:
    found = weights.balanced_weights(plain_labels(spark, sf), factor=0.9)
    return found.select("label", "n", r6("weight").alias("weight"))


@query
def weights_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return weights.ratio_weights(plain_labels(spark, sf)).withColumn("weight", r6("weight"))


@query
def weights_attached(spark: SparkSession, sf: str) -> DataFrame:
    data = plain_labels(spark, sf)
    found = weights.attach_weights(data, weights.balanced_weights(data))
    return found.select("id", "label", r6("weight").alias("weight"))


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.confusion_matrix(predictions(spark, sf), [0, 1])
    return found.select("label", F.col("0").alias("predicted_0"), F.col("1").alias("predicted_1"))


@query
def confusion_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The test rows never get a 2, some predictions do: rows of zeros show."""
    said = predictions(spark, sf).withColumn("prediction", F.col("prediction") * 2)
    return evaluate.confusion_cells(said)


def report_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.class_metrics(evaluate.confusion_cells(predictions(spark, sf)))
    return found.select(
        "label", "tp", "predicted", "support",
        *[r6(c).alias(c) for c in ("precision", "recall", "f1")],
    )


@query
def report_averages(spark: SparkSession, sf: str) -> DataFrame:
    cells = evaluate.confusion_cells(predictions(spark, sf))
    return report_rows(evaluate.averages(evaluate.class_metrics(cells)))


@query
def class_report_full(spark: SparkSession, sf: str) -> DataFrame:
    cells = evaluate.confusion_cells(predictions(spark, sf))
    return report_rows(evaluate.classification_report(cells, {0: "clean", 1: "toxic"}))


@query
def accuracy_overall(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.accuracy(predictions(spark, sf))
    return found.select(r6("accuracy").alias("accuracy"))


@query
def accuracy_by_split(spark: SparkSession, sf: str) -> DataFrame:
    scored = sampling.stratified_split(predictions(spark, sf), 0.2, 42)
    return evaluate.accuracy_by_split(scored).withColumn("accuracy", r6("accuracy"))


@query
def balanced_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.balanced_accuracy(predictions(spark, sf))
    return found.select(r6("balanced_accuracy").alias("balanced_accuracy"))


@query
def positive_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.positive_metrics(predictions(spark, sf))
    return found.select(r6("precision").alias("precision"), r6("recall").alias("recall"))


# ---- models: the metric on unseen rows has to reach a floor -----------------------

FLOOR = 0.95  # balanced accuracy; a constant guess reaches 0.5


def by_language(spark: SparkSession, sf: str) -> DataFrame:
    """All documents; the label says whether they are English."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"), "text",
        (F.col("lang") == "en").cast("int").alias("label"), F.lit(0).alias("source_rank"),
    )


def train_and_test(spark: SparkSession, sf: str):
    rows_in = classical.prepare(by_language(spark, sf), scripts=(LATIN,), order=order())
    return classical.split_and_fold(rows_in.drop("source_rank"), 0.2)


def floor_row(train: DataFrame, test: DataFrame, model) -> DataFrame:
    """``n_train, n_test, floor_met``."""
    found = evaluate.balanced_accuracy(scored(model, test))
    return found.select(
        F.lit(train.count()).alias("n_train"), F.lit(test.count()).alias("n_test"),
        (F.col("balanced_accuracy") >= FLOOR).alias("floor_met"),
    )


def scored(model, test: DataFrame) -> DataFrame:
    return model.transform(test).select(
        "id", "label", F.col("prediction").cast("int").alias("prediction")
    )


@query
def rf_fit(spark: SparkSession, sf: str) -> DataFrame:
    train, test = train_and_test(spark, sf)
    pipeline, _ = classical.forest(numTrees=100)
    return floor_row(train, test, pipeline.fit(train))


@query
def svm_fit(spark: SparkSession, sf: str) -> DataFrame:
    train, test = train_and_test(spark, sf)
    pipeline, _ = classical.svm()
    return floor_row(train, test, pipeline.fit(train))


@query
def svm_probability(spark: SparkSession, sf: str) -> DataFrame:
    """The class by a probability of one half."""
    from pyspark.ml.functions import vector_to_array

    train, test = train_and_test(spark, sf)
    model = classical.svm_with_probability().fit(train)
    said = model.transform(test).select(
        "id", "label",
        (vector_to_array("probability")[1] > 0.5).cast("int").alias("prediction"),
    )
    found = evaluate.balanced_accuracy(said)
    return found.select(
        F.lit(train.count()).alias("n_train"), F.lit(test.count()).alias("n_test"),
        (F.col("balanced_accuracy") >= FLOOR).alias("floor_met"),
    )


@query
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best model of a search over ``C``."""
    train, test = train_and_test(spark, sf)
    pipeline, maps = classical.svm()
    return floor_row(train, test, classical.run_search(pipeline, maps, train).bestModel)


@query
def model_saved(spark: SparkSession, sf: str) -> DataFrame:
    """A model written and read again says the same of every row of the test part."""
    from pyspark.ml import PipelineModel

    train, test = train_and_test(spark, sf)
    model = classical.svm()[0].fit(train)
    out = fresh_folder(spark, "model")
    model.write().save(out)
    again = PipelineModel.load(out)
    both = scored(model, test).join(
        scored(again, test).select("id", F.col("prediction").alias("read")), "id"
    )
    return both.agg(
        F.count("*").alias("n_test"), F.count_if(F.col("prediction") != F.col("read")).alias("n_differ")
    )


@query
def forest_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of the forest's grid, over a bounded sample of the training rows."""
    train, _ = train_and_test(spark, sf)
    sample = stable(sample_rows(train))
    n = sample.count()
    found = classical.run_forest_search(sample)
    rows_out = [
        (r["numTrees"], r["minInstancesPerNode"], r["featureSubsetStrategy"], n, r["score"] >= FLOOR)
        for r in found
    ]
    return spark.createDataFrame(
        rows_out, "n_trees int, min_rows int, features string, n_train bigint, floor_met boolean"
    )


@query
def vector_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Mean word vectors of all documents and a weighted sigmoid unit."""
    data = sampling.stratified_split(by_language(spark, sf), 0.2, 42)
    features = mean_vectors(
        data, fn.sequence_tokens("text"), vectors(spark, sf), ["id", "label", "split"], 64,
        20_000,
    )
    features = stable(features, "id")
    train, test = features.filter("split = 'train'"), features.filter("split = 'test'")
    return floor_row(train, test, weighted_logistic(regParam=0.01).fit(train))


def prepared_words(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned and written once: the split counts its rows several times."""
    prepared_rows = sequence.prepare(by_language(spark, sf), sequence.GRU, order=order())
    return sampling.stratified_split(stable(prepared_rows, "id"), 0.2, 42)


@query
def word2vec_classifier(spark: SparkSession, sf: str) -> DataFrame:
    data = prepared_words(spark, sf)
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    return floor_row(train, test, sequence.fit_learned_vectors(train, sequence.GRU))


@query
def cooccurrence_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors learned from the training part by co-occurrence, averaged, and a sigmoid unit."""
    data = prepared_words(spark, sf)
    tokens = fn.sequence_tokens("clean_text")
    learned = cooccurrence_vectors(data.filter("split = 'train'"), tokens, sequence.GRU.num_words)
    # no size is stated, so the table of vectors is looked up where it lies
    features = mean_vectors(data, tokens, stable(learned), ["id", "label", "split"], 96, 0)
    features = stable(features, "id")
    train, test = features.filter("split = 'train'"), features.filter("split = 'test'")
    return floor_row(train, test, weighted_logistic().fit(train))


@query
def batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings scored in batches by a function from outside."""

    def make_predict():
        import numpy as np

        def predict(x: np.ndarray) -> np.ndarray:
            return 1.0 / (1.0 + np.exp(-x.astype(np.float64).sum(axis=1)))

        return predict

    score = score_batches(make_predict, width=64, batch_size=128)
    return table(spark, sf, "embeddings").select(
        "vec_id", r6(score(F.col("embedding"))).alias("score")
    )


# ---- the training-data subpackage, if it is there ---------------------------------

LIBRARY = frozenset(QUERIES)
LLM_SQL: dict[str, str] = {}
if importlib.util.find_spec("textprep.llm") and importlib.util.find_spec("textprep.llm.queries"):
    _llm = importlib.import_module("textprep.llm.queries")
    QUERIES.update(_llm.QUERIES)
    LLM_SQL.update(_llm.SQL)
    if importlib.util.find_spec("corpus_pipeline"):
        _pipeline = importlib.import_module("corpus_pipeline")
        QUERIES["pipeline"] = _pipeline.run
        if _pipeline.ORACLE_SQL is not None:
            LLM_SQL["pipeline"] = _pipeline.ORACLE_SQL

# ---- driver contract --------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Class shares after cleaning, length filter, conflict removal and dedup."""
    return class_share_prepared(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {**oracle.statements(), **LLM_SQL}
