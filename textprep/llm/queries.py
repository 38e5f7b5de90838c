"""Registered queries of the operators, and their SQL where SQL can state them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.llm import (
    bpe, chat, fingerprint, licenses, mixing, ngram_join, packing, quality, token_counts, toxicity,
    vector_codes, warc, whitening,
)
from textprep.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.token_pieces(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return packing.pack(pieces)


@query
def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(table(spark, sf, "documents"), path)


@query
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.assess(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("probability", 6).alias("probability"),
    )


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op4_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionAll(own)
    read = chat.read_back(chat.format_chats(turns, chat.text_part(F.col("text"))))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op4_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, length(role || text) + length(regexp_replace(role || '|' || text,
    '([<\[])(\\*(?:/?s>|/?INST\]|image>|audio>|document>))', '\1\\\2', 'g'))
    - length(role || '|' || text) AS n
  FROM turns
), grouped AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text)
      FILTER (WHERE role = 'assistant'), '') AS learned,
    CAST(sum(n + 25) AS BIGINT) AS formatted_chars
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars,
  sha256(learned) AS loss_sha256, formatted_chars
FROM grouped
"""


@query
def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf, "pages"), folder)
    return warc.read_index(spark, folder)


SQL["op6_warc"] = """
WITH rows AS (
  SELECT page_id, url, coalesce(html, '') AS payload FROM pages
), digests AS (
  SELECT *, sha1(payload) AS hex,
    row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST, url) AS place,
    min(page_id) OVER (PARTITION BY payload) AS first_id
  FROM rows
)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31
      AS INTEGER) + 1, 1) for k in range(32)], '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM digests
"""


@query
def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


@query
def op1_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf, "documents"))


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(table(spark, sf, "documents"), width=3, percent=90)


@query
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Three edits a document: a deletion, an insertion and a replacement."""
    size = F.length(F.coalesce("text", F.lit("")))
    edits = F.array(*(
        F.struct(
            F.floor(size * part / 4).alias("start"), F.lit(gone).cast("long").alias("delete"),
            F.lit(come).alias("insert"),
        )
        for part, gone, come in ((1, 5, ""), (2, 0, " edit'd 42\n"), (3, 7, "Ünïcode  "))
    ))
    return token_counts.count_edited(
        table(spark, sf, "documents"), edits, public_tokenizers.path("byte_bpe_50k.json")
    )


MIX_WEIGHTS = (3.0, 1.0, 2.0)
MIX_SHARE = 1.5
MIX_EPOCHS = 2.0
MIX_SEED = 42


@query
def op11_mixing(spark: SparkSession, sf: str) -> DataFrame:
    words = mixing.word_count(F.col("text")).alias("words")
    docs = table(spark, sf, "documents").select("doc_id", "source", words)
    mixed = mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED, size=F.col("words"))
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies",
    )


SQL["op11_mixing"] = f"""
WITH docs AS (
  SELECT doc_id, source, row_number() OVER () AS tie,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    list_extract(CAST([{', '.join(map(str, MIX_WEIGHTS))}] AS DOUBLE[]),
      (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(MIX_WEIGHTS)} + 1) AS weight
  FROM docs GROUP BY source
), ordered AS (
  SELECT *, {MIX_EPOCHS} * source_size AS cap,
    row_number() OVER (ORDER BY {MIX_EPOCHS} * source_size / weight, source NULLS LAST) AS place
  FROM sources
), levels AS (
  SELECT *, ({MIX_SHARE}::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM ordered
), found AS (
  SELECT min_by(level, place) FILTER (WHERE weight * level < cap) AS level FROM levels
), targets AS (
  SELECT source, source_size, cap, CASE WHEN found.level IS NULL THEN cap::DOUBLE
    ELSE least(cap::DOUBLE, weight * found.level) END AS target
  FROM levels, found
), goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), sums AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS goal,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY
      md5(concat_ws('|', '{MIX_SEED}', coalesce(CAST(d.doc_id AS VARCHAR), ''), CAST(d.size AS VARCHAR))), tie
      ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(whole + CASE WHEN size > 0 AND 2 * upto - size < 2 * goal THEN 1 ELSE 0 END AS INT) AS copies,
  CAST(whole + CASE WHEN size > 0 AND 2 * upto - size < 2 * goal THEN 1 ELSE 0 END AS BIGINT) * size AS taken
FROM sums
"""

CODE_PARTS, CODE_ENTRIES, CODE_ROUNDS, CODE_FACTOR = 8, 16, 6, 4096


@query
def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = vector_codes.compress(
        table(spark, sf, "embeddings"), CODE_PARTS, CODE_ENTRIES, CODE_ROUNDS, CODE_FACTOR
    )
    return coded.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error",
        F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"),
    )


def _codes_sql() -> str:
    """Lloyd rounds, one after the other, over rows of one component each."""
    nearest = """
  SELECT id, part, CAST(min(d * 256 + entry) AS HUGEINT) % 256 AS entry,
    CAST(min(d * 256 + entry) AS HUGEINT) // 256 AS d FROM (
    SELECT x.id, x.part, b.entry, sum(CAST((x.x - b.x) * (x.x - b.x) AS HUGEINT)) AS d
    FROM xs x JOIN book{i} b USING (part, place) GROUP BY x.id, x.part, b.entry) GROUP BY id, part"""
    parts = ["""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, embedding, label
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
  SELECT id, unnest(embedding) AS c, generate_subscripts(embedding, 1) - 1 AS k, len(embedding) AS size FROM kept
), xs AS MATERIALIZED (
  SELECT id, k // (size // {p}) AS part, k % (size // {p}) AS place,
    CAST(floor({f} * CAST(c AS DOUBLE)) AS BIGINT) AS x FROM flat
), book0 AS MATERIALIZED (
  SELECT part, id - 1 AS entry, place, x FROM xs WHERE id <= {e}
)""".format(p=CODE_PARTS, f=CODE_FACTOR, e=CODE_ENTRIES)]  # fmt: skip
    for i in range(CODE_ROUNDS):
        parts.append(f"""
near{i} AS MATERIALIZED ({nearest.format(i=i)}
), book{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN (
    SELECT n.part, n.entry, x.place,
      CAST((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM near{i} n JOIN xs x USING (id, part) GROUP BY n.part, n.entry, x.place) m USING (part, entry, place)
)""")
    last = nearest.format(i=CODE_ROUNDS)
    parts.append(f"""
last AS MATERIALIZED ({last}
), coded AS (
  SELECT id, string_agg(printf('%02x', CAST(entry AS INT)), '' ORDER BY part) AS code,
    CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY id
), digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS hex FROM book{CODE_ROUNDS}
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  d.hex AS codebooks_sha256
FROM kept k JOIN coded c USING (id), digest d
""")
    return ",".join(parts)


SQL["op12_vector_codes"] = _codes_sql()


@query
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf, "embeddings"), components=8, factor=1024, add=100_000)
    return white.withColumnRenamed("id", "vec_id")
