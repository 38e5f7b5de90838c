"""SQL that states each registered query for DuckDB, over the same tables."""

from __future__ import annotations

# Latin letters and the Devanagari characters that stand for them in derived tweets;
# vowels become vowel signs, so words carry combining marks.
DEVA_FROM = "abcdefghijklmnopqrstuvwxyz"
DEVA_TO = (
    "ाबचदेफगहिजकलम"
    "नोपतरसटुवंखीज़"
)

SP = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
WORD = {"strip": r"\p{L}\p{N}_", "keep": r"\p{L}\p{M}\p{N}_"}
DEVA = r"\x{0900}-\x{097F}"
LATIN = r"A-Za-z\x{00AA}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}"
FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def url(x: str, wide: bool = False) -> str:
    return sub(x, f"http[^{SP}]+" + (f"|www[^{SP}]+" if wide else ""))


def mention(x: str, m: str) -> str:
    return sub(x, f"@[{WORD[m]}]+")


def hashtag(x: str, m: str) -> str:
    return sub(x, f"#[{WORD[m]}]+")


def unwrap(x: str, m: str) -> str:
    return sub(x, f"#([{WORD[m]}]+)", r"\1")


def social(x: str, m: str) -> str:
    return sub(x, f"http[^{SP}]+|www[^{SP}]+|@[{WORD[m]}]+|#[{WORD[m]}]+")


def only(x: str, members: str) -> str:
    return sub(x, f"[^{members}{SP}]")


def repeats(x: str) -> str:
    return sub(sub(x, "!+", "!"), r"\?+", "?")


def space(x: str) -> str:
    return f"trim({sub(x, f'[{SP}]+', ' ')})"


def word_basic(x: str, m: str) -> str:
    return space(only(mention(url(x), m), WORD[m]))


def script_strict(x: str, m: str, script: str = DEVA) -> str:
    return space(only(social(x, m), script + '!?,.;:"'))


def script_letters(x: str, m: str) -> str:
    return space(only(unwrap(mention(url(x, True), m), m), DEVA + r"\p{L}!?.,:;"))


def script_only(x: str, m: str) -> str:
    return space(only(unwrap(mention(url(x, True), m), m), DEVA + "!?.,:;"))


def punct_lower(x: str, m: str) -> str:
    return f"lower({space(only(repeats(mention(url(x, True), m)), WORD[m] + '!?'))})"


def deva(x: str) -> str:
    return f"translate(lower({x}), '{DEVA_FROM}', '{DEVA_TO}')"


TWEET = (
    f"concat('@', {deva('source')}, ' #', {deva('lang')}, ' ', {deva('text')}, ' http://', lang,"
    f" '.example/', doc_id, '!!?? www.', source, '.example ', {deva('source')})"
)
TWEETS = f"(SELECT doc_id, {TWEET} AS text FROM documents)"


def on_tweets(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS result FROM {TWEETS}"


def on_documents(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS result FROM documents"


def on_pages(expr: str) -> str:
    return f"SELECT page_id, {expr} AS result FROM (SELECT page_id, concat_ws(' ', url, html) AS text FROM pages)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


LAB = """lab AS (
  SELECT d.doc_id AS id, d.text, l.toxic AS label, l.quality,
         CASE WHEN l.toxic = 1 THEN 0 ELSE 1 END AS source_rank
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SOURCED = f"""sourced AS (
  SELECT {word_basic("text", "strip")} AS key, doc_id AS id, source AS label,
         CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS source_rank FROM documents)"""
PLAIN = "plain AS (SELECT doc_id AS id, toxic AS label FROM labels)"
EVENTS = "plain AS (SELECT event_id AS id, event_type AS label FROM events)"
PRED = "pred AS (SELECT doc_id AS id, toxic AS label, quality AS prediction FROM labels)"


def split_ctes(source: str, fraction: str, seed: int) -> str:
    """``sp``: the rows of ``source`` with their split."""
    return f"""sizes AS (
  SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM {source} GROUP BY label),
shares AS (
  SELECT label, c, n, ceil(n * {fraction}::DOUBLE)::BIGINT AS t FROM sizes),
floors AS (
  SELECT label, t, (c * t) // n AS q, (c * t) % n AS rest FROM shares),
quotas AS (
  SELECT label, q + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
                           <= t - sum(q) OVER () THEN 1 ELSE 0 END AS quota FROM floors),
sp AS (
  SELECT r.*, CASE WHEN row_number() OVER (
                     PARTITION BY r.label ORDER BY md5(concat('{seed}|', r.id))) <= q.quota
                   THEN 'test' ELSE 'train' END AS split
  FROM {source} r JOIN quotas q ON r.label = q.label)"""


def seq_tokens(x: str) -> str:
    table = f"translate(lower({x}), '{FILTERS}' || chr(9) || chr(10), '{' ' * (len(FILTERS) + 2)}')"
    return f"list_filter(string_split({table}, ' '), lambda t: t <> '')"


def vocab_ctes(start: int = 1) -> str:
    return f"""{LAB},
{split_ctes("lab", "0.2", 42)},
tok AS (SELECT unnest({seq_tokens("text")}) AS term FROM sp WHERE split = 'train'),
cnt AS (SELECT term, count(*) AS tf FROM tok GROUP BY term),
full_vocab AS (
  SELECT term, (row_number() OVER (ORDER BY tf DESC, term) + {start - 1})::INTEGER AS idx, tf FROM cnt),
vocab AS (SELECT * FROM full_vocab WHERE idx < 800)"""


def encode_ctes(oov: bool) -> str:
    """``seqs``: id and list of word ids."""
    idx = "coalesce(v.idx, 1)" if oov else "v.idx"
    return f"""{vocab_ctes(2 if oov else 1)},
pos AS (
  SELECT id, unnest(toks) AS term, generate_subscripts(toks, 1) AS p
  FROM (SELECT id, {seq_tokens("text")} AS toks FROM lab)),
hits AS (SELECT id, p, {idx} AS idx FROM pos LEFT JOIN vocab v ON pos.term = v.term),
lists AS (SELECT id, list(idx ORDER BY p) AS s FROM hits WHERE idx IS NOT NULL GROUP BY id),
seqs AS (SELECT lab.id, coalesce(s, []) AS s FROM lab LEFT JOIN lists ON lab.id = lists.id)"""


def padded(length: int, padding: str, truncating: str, oov: bool) -> str:
    cut = (
        f"CASE WHEN len(s) > {length} THEN s[len(s) - {length} + 1 : len(s)] ELSE s END"
        if truncating == "pre"
        else f"s[1:{length}]"
    )
    zeros = f"list_transform(range(greatest({length} - len(s), 0)), lambda x: 0)"
    both = f"list_concat({cut}, {zeros})" if padding == "post" else f"list_concat({zeros}, {cut})"
    return f"{with_(encode_ctes(oov))}SELECT id, array_to_string({both}, ' ') AS seq FROM seqs"


VECTORS = f"""{vocab_ctes()},
vec AS (SELECT f.term, e.embedding AS vector
        FROM embeddings e JOIN full_vocab f ON e.vec_id + 1 = f.idx)"""


def vector_summary(keys: str, source: str) -> str:
    return f"""SELECT {keys}, len(vector)::BIGINT AS dim,
  round(list_sum(list_transform(vector, lambda x: x::DOUBLE)), 4) AS total,
  round(vector[len(vector)]::DOUBLE, 5) AS last_value FROM {source}"""


ZERO = "list_transform(range(64), lambda x: 0.0::FLOAT)"


def word_tokens(x: str, m: str = "strip") -> str:
    return f"regexp_extract_all(lower({x}), '[{WORD[m]}]{{2,}}')"


def grams(source: str, keys: str) -> str:
    """``g``: keys and term, once per occurrence."""
    return f"""words AS (SELECT {keys}, {word_tokens("text")} AS w FROM {source}),
g AS (
  SELECT {keys}, unnest(w) AS term FROM words
  UNION ALL
  SELECT {keys}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term
  FROM words)"""


TFIDF = f"""{LAB},
{grams("lab", "id, label")},
tf AS (SELECT id, label, term, count(*) AS tf FROM g GROUP BY ALL),
n AS (SELECT count(*) AS n FROM labels),
bounded AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM tf GROUP BY term
  HAVING count(*) >= 7 AND count(*) <= 0.75::DOUBLE * (SELECT n FROM n)),
capped AS (SELECT * FROM bounded ORDER BY tf DESC, term LIMIT 3000),
raw AS (
  SELECT tf.id, tf.label, tf.term,
         (1 + ln(tf.tf)) * (ln((1.0 + n.n) / (1.0 + c.df)) + 1) AS w
  FROM tf JOIN capped c ON tf.term = c.term, n),
weights AS (
  SELECT id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""

CHI2 = f"""{TFIDF},
classes AS (SELECT toxic AS label, count(*)::DOUBLE / sum(count(*)) OVER () AS share
            FROM labels GROUP BY toxic),
totals AS (SELECT term, sum(weight) AS total FROM weights GROUP BY term),
observed AS (SELECT term, label, sum(weight) AS o FROM weights GROUP BY term, label),
scores AS (
  SELECT t.term, sum((coalesce(o.o, 0) - c.share * t.total) ** 2 / (c.share * t.total)) AS chi2
  FROM totals t JOIN classes c ON true
  LEFT JOIN observed o ON o.term = t.term AND o.label = c.label GROUP BY t.term),
best AS (SELECT * FROM scores ORDER BY round(chi2, 9) DESC, term LIMIT 1500)"""

METRICS = f"""{PRED},
classes AS (SELECT label FROM pred UNION SELECT prediction FROM pred),
metrics AS (
  SELECT c.label,
         count(*) FILTER (WHERE p.label = c.label AND p.prediction = c.label) AS tp,
         count(*) FILTER (WHERE p.prediction = c.label) AS predicted,
         count(*) FILTER (WHERE p.label = c.label) AS support
  FROM classes c JOIN pred p ON p.label = c.label OR p.prediction = c.label GROUP BY c.label),
ratios AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
            CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
            CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1
  FROM metrics)"""
ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
AVERAGES = """SELECT 'accuracy' AS class, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall,
       round(sum(tp) / sum(support), 6) AS f1, sum(support)::BIGINT AS support FROM ratios
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       sum(support)::BIGINT FROM ratios
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM ratios"""


def first_of(source: str, key: str, by: str, columns: str) -> str:
    return f"""SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by}) AS rn FROM {source}) WHERE rn = 1"""


def balanced(column: str, source: str, factor: str) -> str:
    return f"""SELECT {column}, count(*) AS n,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)) * {factor}, 6) AS weight
FROM {source} GROUP BY {column}"""


def undersample(source: str, seed: int) -> str:
    return f"""{with_(source)}SELECT id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('{seed}|', id))) AS rn
  FROM plain)
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM plain GROUP BY label))"""


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    x = "text"

    # text functions
    q["strip_url_narrow"] = on_pages(url(x))
    q["strip_url_wide"] = on_pages(url(x, True))
    for m in ("strip", "keep"):
        q[f"strip_mention_{m}"] = on_tweets(mention(x, m))
        q[f"hashtag_drop_{m}"] = on_tweets(hashtag(x, m))
        q[f"hashtag_unwrap_{m}"] = on_tweets(unwrap(x, m))
        q[f"strip_social_{m}"] = on_tweets(social(x, m))
        q[f"keep_words_{m}"] = on_tweets(only(x, WORD[m]))
        q[f"keep_words_punct_{m}"] = on_tweets(only(x, WORD[m] + "!?"))
        q[f"clean_word_basic_{m}"] = on_tweets(word_basic(x, m))
        q[f"clean_script_strict_{m}"] = on_tweets(script_strict(x, m))
        q[f"clean_script_letters_{m}"] = on_tweets(script_letters(x, m))
        q[f"clean_script_only_{m}"] = on_tweets(script_only(x, m))
        q[f"clean_punct_lower_{m}"] = on_tweets(punct_lower(x, m))
        q[f"tfidf_tokens_{m}"] = (
            f"SELECT doc_id, array_to_string({word_tokens(x, m)}, ' ') AS tokens FROM {TWEETS}"
        )
    q["clean_word_basic_documents"] = on_documents(word_basic(x, "strip"))
    q["clean_punct_lower_documents"] = on_documents(punct_lower(x, "strip"))
    q["clean_script_strict_latin"] = on_documents(script_strict(x, "strip", LATIN))
    q["script_filter_quotes"] = on_tweets(only(x, DEVA + '!?,.;:"'))
    q["script_filter_letters"] = on_tweets(only(x, DEVA + r"\p{L}!?.,:;"))
    q["script_filter_only"] = on_tweets(only(x, DEVA + "!?.,:;"))
    q["collapse_repeats"] = on_documents(repeats(x))
    q["collapse_space"] = on_pages(space(x))
    q["lower_case"] = on_documents("lower(text)")
    q["split_space"] = on_pages(
        f"array_to_string(list_filter(regexp_split_to_array(text, '[{SP}]+'), lambda t: t <> ''), '|')"
    )

    # rows, labels, union
    q["required_columns"] = "SELECT doc_id, text FROM documents"
    q["label_union"] = """SELECT text, lang, NULL::VARCHAR AS role, 'document' AS label,
  0 AS source_rank FROM documents
UNION ALL SELECT text, NULL, role, 'conversation', 1 FROM conversations"""
    q["drop_columns"] = "SELECT doc_id, text, n_chars FROM documents"
    q["stable_row_id"] = "SELECT 3 AS source_rank, count(*) AS n, count(*) AS n_ids FROM documents"
    q["drop_null_text"] = "SELECT doc_id, lang AS text FROM documents WHERE lang <> 'de'"
    left = space(sub("lower(text)", "[" + chr(92) + "x00-" + chr(92) + "x7F]+", " "))
    q["drop_blank"] = f"""SELECT * FROM (
  SELECT doc_id, {left} AS clean_text FROM documents) WHERE clean_text <> ''"""
    q["min_length"] = f"""SELECT * FROM (
  SELECT doc_id, {word_basic(x, "strip")} AS clean_text FROM documents)
WHERE length(clean_text) > 500"""
    q["cast_text"] = """SELECT doc_id,
  CASE WHEN n_chars <> length(text) THEN n_chars::VARCHAR END AS a, n_chars::VARCHAR AS b
FROM documents"""
    q["decode_label"] = """SELECT doc_id, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS label
FROM labels"""
    q["select_text_label"] = (
        with_(LAB) + f"SELECT {word_basic(x, 'strip')} AS clean_text, label FROM lab"
    )
    q["threshold_score"] = """SELECT event_id,
  CASE WHEN value / 100.0 > 0.5 THEN 1 ELSE 0 END AS prediction FROM events"""
    q["index_to_label"] = """SELECT doc_id, CASE toxic WHEN 0 THEN 'clean' WHEN 1 THEN 'toxic' END
  AS name FROM labels"""

    # sources and sinks
    q["csv_scan"] = with_(LAB) + "SELECT id::VARCHAR AS tweet_id, text, label, source_rank FROM lab"
    line = sub(f"concat('> ', {sub('text', '[' + chr(92) + 'r' + chr(92) + 'n]+', ' ')})", f"^[{SP}]+|[{SP}]+$")
    q["id_value_lines"] = with_(LAB) + f"SELECT id::VARCHAR AS id, {line} AS text, label FROM lab"
    q["vector_file"] = vector_summary(
        "term", "(SELECT concat('w', vec_id) AS term, embedding AS vector FROM embeddings)"
    )

    # dedup, conflicts, joins
    clean = f"cleaned AS (SELECT *, {word_basic(x, 'strip')} AS clean_text FROM lab)"
    clean_docs = (
        f"cleaned AS (SELECT doc_id, {word_basic(x, 'strip')} AS clean_text FROM documents)"
    )
    q["dedup_raw_first"] = first_of("documents", "text", "doc_id", "doc_id, text, lang")
    q["dedup_clean_first"] = with_(LAB, clean) + first_of(
        "cleaned", "clean_text", "source_rank, id", "id, source_rank, clean_text, label"
    )
    q["dedup_source_first"] = with_(SOURCED) + first_of(
        "sourced", "key", "source_rank, id", "key, id, label, source_rank"
    )
    q["duplicate_members"] = with_(clean_docs) + """SELECT doc_id, clean_text FROM (
  SELECT *, count(*) OVER (PARTITION BY clean_text) AS n FROM cleaned) WHERE n > 1"""
    q["duplicate_count"] = with_(clean_docs) + """SELECT coalesce(sum(n), 0)::BIGINT AS n FROM (
  SELECT count(*) AS n FROM cleaned GROUP BY clean_text HAVING count(*) > 1)"""
    q["conflict_groups"] = with_(SOURCED) + """SELECT key, count(DISTINCT label) AS n_labels,
  count(*) AS n_rows FROM sourced GROUP BY key HAVING count(DISTINCT label) > 1"""
    bad = "SELECT key FROM sourced GROUP BY key HAVING count(DISTINCT label) > 1"
    q["conflict_anti_join"] = (
        with_(SOURCED)
        + f"SELECT key, id, label, source_rank FROM sourced WHERE key NOT IN ({bad})"
    )
    q["conflict_removed"] = with_(SOURCED) + first_of(
        f"(SELECT * FROM sourced WHERE key NOT IN ({bad}))", "key", "source_rank, id",
        "key, id, label, source_rank",
    )
    long_only = "longer AS (SELECT * FROM cleaned WHERE length(clean_text) > 300)"
    bad_text = "SELECT clean_text FROM longer GROUP BY 1 HAVING count(DISTINCT label) > 1"
    agreed = f"agreed AS (SELECT * FROM longer WHERE clean_text NOT IN ({bad_text}))"
    longer = "longer AS (SELECT key AS clean_text, id, label, source_rank FROM sourced WHERE length(key) > 300)"
    q["conflict_removed_text"] = with_(SOURCED, longer, agreed) + first_of(
        "agreed", "clean_text", "source_rank, id", "id, label, source_rank, clean_text"
    )
    q["class_share_prepared"] = with_(LAB, clean, long_only, agreed) + """SELECT label,
  count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM (SELECT DISTINCT clean_text, label FROM agreed) GROUP BY label"""
    told = f"""told AS (SELECT doc_id AS id, {deva("text")} AS text, source AS label,
  CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS source_rank FROM documents)"""
    for name, clean_text, rule in (
        ("gru", script_letters, "raw"), ("lstm", punct_lower, "none"),
        ("vector_lstm", word_basic, "conflict"), ("vector_gru", script_only, "none"),
        ("frozen_lstm", word_basic, "conflict"),
    ):
        columns = "id, label, source_rank, clean_text"
        firsts = first_of("told", "text", "source_rank, id", "id, text, label, source_rank")
        start = f"({firsts})" if rule == "raw" else "told"
        done = f"""done AS (SELECT id, label, source_rank, {clean_text("text", "keep")} AS clean_text
  FROM {start})"""
        kept = "kept AS (SELECT * FROM done WHERE clean_text <> '')"
        bad_keys = "SELECT clean_text FROM kept GROUP BY 1 HAVING count(DISTINCT label) > 1"
        q[f"prepare_{name}"] = with_(told, done, kept) + (
            first_of(
                f"(SELECT * FROM kept WHERE clean_text NOT IN ({bad_keys}))", "clean_text",
                "source_rank, id", columns,
            )
            if rule == "conflict"
            else f"SELECT {columns} FROM kept"
        )
    q["vocab_distinct"] = with_(clean_docs) + """SELECT DISTINCT term FROM (
  SELECT unnest(string_split(clean_text, ' ')) AS term FROM cleaned) WHERE term <> ''"""
    q["label_join"] = with_(LAB) + "SELECT id, text, label FROM lab"

    # class profile
    q["row_count"] = "SELECT count(*) AS n FROM documents"
    q["class_counts"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"
    q["class_share"] = """SELECT role, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (), 6) AS share FROM conversations GROUP BY role"""
    q["class_dense_counts"] = """WITH c AS (
  SELECT quality * 2 + quality * toxic AS label, count(*) AS n FROM labels GROUP BY 1)
SELECT s.label::INTEGER AS label, coalesce(c.n, 0) AS n
FROM (SELECT unnest(range((SELECT max(label) + 1 FROM c))) AS label) s
LEFT JOIN c ON s.label = c.label"""
    q["positive_ratio"] = """SELECT round(avg(toxic), 6) AS ratio,
  printf('%.2f%%', avg(toxic) * 100) AS percent FROM labels"""
    q["distinct_per_group"] = with_(SOURCED) + """SELECT key,
  count(DISTINCT label) AS n_distinct FROM sourced GROUP BY key"""
    q["min_class_size"] = """SELECT min(c) AS n FROM (
  SELECT count(*) AS c FROM labels GROUP BY toxic)"""
    q["count_class"] = "SELECT count(*) AS n FROM labels WHERE toxic = 0"
    q["distinct_labels"] = "SELECT DISTINCT event_type FROM events"

    # split, sampling, folds
    q["stratified_split"] = (
        with_(PLAIN, split_ctes("plain", "0.2", 42)) + "SELECT id, label, split FROM sp"
    )
    q["stratified_split_events"] = (
        with_(EVENTS, split_ctes("plain", "0.3", 91)) + "SELECT id, label, split FROM sp"
    )
    q["undersample"] = undersample(PLAIN, 42)
    q["undersample_events"] = undersample(EVENTS, 7)
    q["stratified_folds"] = with_(PLAIN) + """SELECT id, label,
  (ntile(5) OVER (PARTITION BY label ORDER BY md5(concat('42|', id))) - 1)::INTEGER AS fold
FROM plain"""

    # sequences and vectors
    q["vocab_fit"] = with_(vocab_ctes()) + "SELECT term, idx, tf FROM vocab"
    q["vocab_fit_oov"] = with_(vocab_ctes(2)) + "SELECT term, idx, tf FROM vocab"
    q["vocab_fit_full"] = f"""WITH tok AS (SELECT unnest({seq_tokens(x)}) AS term FROM documents)
SELECT term, (row_number() OVER (ORDER BY count(*) DESC, term))::INTEGER AS idx, count(*) AS tf
FROM tok GROUP BY term"""
    q["token_lookup"] = with_(vocab_ctes(), f"""pos AS (
  SELECT id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos
  FROM (SELECT id, {seq_tokens(x)} AS toks FROM lab))""") + """SELECT pos.id, pos.pos, pos.term,
  v.idx FROM pos LEFT JOIN vocab v ON pos.term = v.term"""  # fmt: skip
    for oov in (False, True):
        sql = f"{with_(encode_ctes(oov))}SELECT id, array_to_string(s, ' ') AS seq FROM seqs"
        q["seq_encode_oov" if oov else "seq_encode"] = sql
    q["vocab_model_encode"] = q["seq_encode_oov"]
    q["seq_encode_full"] = f"""WITH toks AS (SELECT doc_id, {seq_tokens(x)} AS t FROM documents),
pos AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM toks),
vocab AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS idx FROM pos GROUP BY term),
seqs AS (SELECT doc_id, string_agg(idx::VARCHAR, ' ' ORDER BY pos) AS seq
  FROM pos JOIN vocab USING (term) GROUP BY doc_id)
SELECT toks.doc_id, coalesce(seq, '') AS seq FROM toks LEFT JOIN seqs USING (doc_id)"""
    q["pad_post_trunc_pre"] = padded(35, "post", "pre", True)
    q["pad_post_trunc_post"] = padded(100, "post", "post", False)
    q["pad_pre_trunc_pre"] = padded(64, "pre", "pre", False)
    for name, words in (("vector_table", "vocab"), ("vector_table_full", "full_vocab")):
        q[name] = with_(
            VECTORS,
            f"""tab AS (SELECT w.idx, w.term, coalesce(vec.vector, {ZERO}) AS vector
FROM {words} w LEFT JOIN vec ON w.term = vec.term)""",
        ) + vector_summary("idx, term", "tab")
    def unit(part: int) -> str:
        text = f"concat_ws('|', '42', w.term, i, '{part}')"
        return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"

    drawn = f"""list_transform(range(1, 65), lambda i:
  (0.6::DOUBLE * sqrt(-2.0 * ln({unit(0)})) * cos(2.0 * pi() * {unit(1)}))::FLOAT)"""
    q["vector_missing_normal"] = with_(
        VECTORS,
        f"""tab AS (SELECT w.idx, w.term, coalesce(vec.vector, {drawn}) AS vector
FROM vocab w LEFT JOIN vec ON w.term = vec.term)""",
    ) + vector_summary("idx, term", "tab")
    q["vector_limited"] = with_(
        "plain AS (SELECT doc_id AS id, text, toxic AS label FROM documents JOIN labels USING (doc_id))",
        f"""ranked AS (SELECT *, row_number() OVER (
  PARTITION BY label ORDER BY md5(concat('42|', id))) AS rn FROM plain)""",
        """picked AS (SELECT * FROM ranked WHERE rn <= (
  SELECT min(c) FROM (SELECT count(*) AS c FROM plain GROUP BY label)))""",
        f"words AS (SELECT DISTINCT unnest({seq_tokens(x)}) AS term FROM picked)",
        f"occ_all AS (SELECT unnest({seq_tokens(x)}) AS term FROM documents)",
        """known AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS idx
  FROM occ_all GROUP BY term)""",
        """named AS (SELECT term, embedding AS vector FROM embeddings JOIN known ON vec_id + 1 = idx
  UNION ALL SELECT concat('none', vec_id), embedding FROM embeddings)""",
        "found AS (SELECT * FROM named WHERE term IN (SELECT term FROM words))",
    ) + vector_summary("term", "found")
    told_all = """told AS (SELECT doc_id AS id, text, CAST(lang = 'en' AS INTEGER) AS label FROM documents)"""

    def parts(cleaned_text: str, start: str, least: int, picked: str) -> str:
        return with_(
            told_all,
            f"done AS (SELECT id, label, {cleaned_text} AS clean_text FROM {start})",
            f"kept AS (SELECT * FROM done WHERE length(clean_text) > {least})",
            f"picked AS ({picked})",
            split_ctes("picked", "0.2", 42),
        )

    n_train = "count(*) FILTER (WHERE split = 'train')"
    n_test = "count(*) FILTER (WHERE split = 'test') AS n_test"
    firsts = first_of("kept", "clean_text", "id", "id, label, clean_text")
    latin = parts(script_strict("text", "keep", LATIN), "told", 10, firsts)
    for name in ("rf_fit", "svm_fit", "svm_probability", "grid_search"):
        q[name] = f"{latin}SELECT {n_train} AS n_train, {n_test}, TRUE AS floor_met FROM sp"
    q["model_saved"] = f"{latin}SELECT {n_test}, 0 AS n_differ FROM sp"
    raw_first = f"({first_of('told', 'text', 'id', 'id, text, label')})"
    letters = parts(script_letters("text", "keep"), raw_first, 0, "SELECT * FROM kept")
    for name in ("word2vec_classifier", "cooccurrence_classifier"):
        q[name] = f"""{letters}SELECT {n_train} AS n_train, {n_test},
  TRUE AS floor_met FROM sp"""
    q["vector_classifier"] = f"""{with_(told_all, split_ctes('told', '0.2', 42))}
SELECT {n_train} AS n_train, {n_test}, TRUE AS floor_met FROM sp"""
    # the sample keeps the classes' shares of at most 2,000 rows of the training part
    q["forest_search"] = f"""{latin.rstrip()}, sample AS (
  SELECT least(count(*), 2000)::BIGINT AS n FROM sp WHERE split = 'train')
SELECT n_trees, min_rows, features, n AS n_train, TRUE AS floor_met FROM sample,
  (VALUES (100), (200)) a(n_trees), (VALUES (5), (10)) b(min_rows), (VALUES ('sqrt'), ('0.5')) c(features)"""
    q["vector_dimension"] = """SELECT min(len(embedding))::BIGINT AS min_dim,
  max(len(embedding))::BIGINT AS max_dim FROM embeddings"""
    q["vector_means"] = with_(
        VECTORS,
        f"occ AS (SELECT id, unnest({seq_tokens(x)}) AS term FROM lab)",
        """hit AS (SELECT id, list_sum(list_transform(vector, lambda x: x::DOUBLE)) AS s,
  vector[len(vector)]::DOUBLE AS l FROM occ JOIN vec ON occ.term = vec.term)""",
        "m AS (SELECT id, avg(s) AS s, avg(l) AS l FROM hit GROUP BY id)",
    ) + """SELECT lab.id, round(coalesce(m.s, 0), 6) AS total,
  round(coalesce(m.l, 0), 6) AS last_value FROM lab LEFT JOIN m ON lab.id = m.id"""

    # TF-IDF and selection
    q["ngrams"] = f"""SELECT doc_id, array_to_string(list_concat(w,
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), '|') AS grams
FROM (SELECT doc_id, {word_tokens(x)} AS w FROM documents)"""
    q["term_frequencies"] = with_(grams("documents", "doc_id")) + """SELECT doc_id, term,
  count(*) AS tf FROM g GROUP BY ALL"""
    q["df_bounds"] = with_(TFIDF) + "SELECT term, df, tf FROM bounded"
    q["vocab_cap"] = with_(TFIDF) + """SELECT term, df, tf FROM bounded
ORDER BY tf DESC, term LIMIT 1000"""
    q["tfidf_weights"] = with_(TFIDF) + "SELECT id, term, round(weight, 6) AS weight FROM weights"
    q["chi2_scores"] = with_(CHI2) + "SELECT term, round(chi2, 6) AS chi2 FROM scores"
    q["chi2_topk"] = with_(CHI2) + "SELECT term, round(chi2, 6) AS chi2 FROM best"
    q["chi2_projected"] = with_(CHI2) + """SELECT id, term, round(weight, 6) AS weight
FROM weights WHERE term IN (SELECT term FROM best)"""
    q["tfidf_vectors"] = with_(TFIDF) + """SELECT lab.id, count(w.term) AS n_terms,
  round(coalesce(sum(w.weight), 0), 6) AS total
FROM lab LEFT JOIN weights w ON lab.id = w.id GROUP BY lab.id"""

    # weights and evaluation
    q["weights_balanced"] = balanced("event_type", "events", "1.0")
    q["weights_scaled"] = with_(PLAIN) + balanced("label", "plain", "0.9")
    q["weights_ratio"] = """SELECT 0 AS label, 1.0::DOUBLE AS weight
UNION ALL SELECT 1, round(count(*) FILTER (WHERE toxic = 0) / count(*) FILTER (WHERE toxic = 1), 6)
FROM labels"""
    q["weights_attached"] = with_(PLAIN, f"w AS ({balanced('label', 'plain', '1.0')})") + (
        "SELECT plain.id, plain.label, w.weight FROM plain JOIN w ON plain.label = w.label"
    )
    q["confusion_matrix"] = with_(PRED) + """SELECT label,
  count(*) FILTER (WHERE prediction = 0) AS predicted_0,
  count(*) FILTER (WHERE prediction = 1) AS predicted_1 FROM pred GROUP BY label"""
    q["confusion_cells"] = """WITH pred AS (
  SELECT toxic AS label, quality * 2 AS prediction FROM labels),
k AS (SELECT label FROM pred UNION SELECT prediction FROM pred)
SELECT a.label, b.label AS prediction, count(p.label) AS n
FROM k a JOIN k b ON true LEFT JOIN pred p ON p.label = a.label AND p.prediction = b.label
GROUP BY a.label, b.label"""
    q["class_report"] = with_(METRICS) + f"""SELECT label, tp, predicted, support, {ROUNDED}
FROM ratios"""
    q["report_averages"] = with_(METRICS) + AVERAGES
    q["class_report_full"] = with_(METRICS) + f"""SELECT CASE label WHEN 0 THEN 'clean'
  ELSE 'toxic' END AS class, {ROUNDED}, support FROM ratios UNION ALL {AVERAGES}"""
    q["report_sink"] = q["class_report_full"]
    right = "avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)"
    q["accuracy_overall"] = with_(PRED) + f"SELECT round({right}, 6) AS accuracy FROM pred"
    q["accuracy_by_split"] = (
        with_(PRED, split_ctes("pred", "0.2", 42))
        + f"SELECT split, round({right}, 6) AS accuracy FROM sp GROUP BY split"
    )
    q["balanced_accuracy"] = with_(PRED) + f"""SELECT round(avg(r), 6) AS balanced_accuracy
FROM (SELECT {right} AS r FROM pred GROUP BY label)"""
    q["positive_metrics"] = with_(METRICS) + """SELECT round(precision, 6) AS precision,
  round(recall, 6) AS recall FROM ratios WHERE label = 1"""
    q["batch_score"] = """SELECT vec_id, round(1.0 / (1.0 + exp(-list_sum(list_transform(embedding, lambda x: x::DOUBLE)))), 6) AS score
FROM embeddings"""
    return q
