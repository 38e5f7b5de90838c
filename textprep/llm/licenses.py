"""License texts by diagonal voting.

All rolling word k-grams of all texts are joined to the places where license templates hold
them. A gram at word ``p`` of a text and word ``t`` of a template votes for the diagonal
``p - t``, the word at which the template would begin. Neighbouring diagonals of a template
are one place with words put in or left out. A place is accepted by the share of the
template's grams that voted for it; the grams' words are compared, not only their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textprep.llm.common import write_once

# What a word is; phrases that have to stand complete, and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Words of public license notices, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind "
    "either express or implied": "apache-notice",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of "
    "the gnu general public license as published by the free software foundation": "gpl-notice",
    "this work is licensed under a creative commons attribution 4 0 international license":
        "cc-by-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files the software to deal in the software without "
    "restriction": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0":
        "mpl-2.0",
}
# Whole public licenses, and their labels. Words only, as :data:`WORD` finds them.
LICENSES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files the software to deal in the software without "
    "restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions the above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions "
    "of the software the software is provided as is without warranty of any kind express or "
    "implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall the authors or copyright holders "
    "be liable for any claim damages or other liability whether in an action of contract tort "
    "or otherwise arising from out of or in connection with the software or the use or other "
    "dealings in the software": "mit-text",
    "permission to use copy modify and or distribute this software for any purpose with or "
    "without fee is hereby granted provided that the above copyright notice and this permission "
    "notice appear in all copies the software is provided as is and the author disclaims all "
    "warranties with regard to this software including all implied warranties of "
    "merchantability and fitness in no event shall the author be liable for any special direct "
    "indirect or consequential damages or any damages whatsoever resulting from loss of use "
    "data or profits whether in an action of contract negligence or other tortious action "
    "arising out of or in connection with the use or performance of this software": "isc-text",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met redistributions of source code "
    "must retain the above copyright notice this list of conditions and the following "
    "disclaimer redistributions in binary form must reproduce the above copyright notice this "
    "list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution this software is provided by the copyright "
    "holders and contributors as is and any express or implied warranties including but not "
    "limited to the implied warranties of merchantability and fitness for a particular purpose "
    "are disclaimed in no event shall the copyright holder or contributors be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not "
    "limited to procurement of substitute goods or services loss of use data or profits or "
    "business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the "
    "use of this software even if advised of the possibility of such damage": "bsd-2-text",
}
PHRASE_GRAM, NOTICE_GRAM = 2, 4
SLACK = 4  # words that may be put in or left out between neighbouring diagonals
LEAST = 0.6  # share of a notice's grams; a notice of few grams has to be whole
FEW = 12


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), 1)


def template_grams(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """``gram, places``: a hash and all template places of the gram, a table as small as the
    templates."""
    rows = []
    for number, (text, label) in enumerate(sorted(templates.items())):
        parts = text.split()
        for at in range(len(parts) - k + 1):
            rows.append((number, label, len(parts) - k + 1, at, parts[at : at + k]))
    table = spark.createDataFrame(
        rows, "template int, label string, grams int, at int, words array<string>"
    )
    place = F.struct("template", "label", "grams", "at", "words", F.lit(k).alias("k"))
    return table.groupBy(F.xxhash64(*(F.get("words", i) for i in range(k))).alias("gram")).agg(
        F.collect_list(place).alias("places")
    )


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES | LICENSES,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts places of whole phrases, ``first_word`` and ``last_word`` are their
    smallest and largest start (null without any); labels are distinct, sorted and joined by
    commas; ``notices`` are the templates of the method's own labels, texts of any length;
    ``score`` is the best share of grams of an accepted place, 0 without one. Null
    and empty texts have no words. Rows equal in id and text each get their own result row,
    as do rows with a null id; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), words(text).alias("w")
    )
    ahead = [F.slice("w", F.lit(i + 1), F.size("w")).alias(f"w{i}") for i in range(NOTICE_GRAM)]
    rolled = split.select(
        "doc_id", "version", F.size("w").cast("long").alias("n_words"),
        F.posexplode_outer(F.arrays_zip(*ahead)).alias("pos", "g"),
    ).select(
        "doc_id", "version", "n_words", "pos",
        *(F.col(f"g.w{i}").alias(f"w{i}") for i in range(NOTICE_GRAM)),
    )

    def joined(rows: DataFrame, templates: dict[str, str], k: int, into: str) -> DataFrame:
        table = template_grams(spark, templates, k).withColumnsRenamed({"gram": f"{into}_gram", "places": into})
        hashed = rows.withColumn(f"{into}_hash", F.xxhash64(*(f"w{i}" for i in range(k))))
        # the templates are a fixed list, whatever the number of documents
        return hashed.join(
            F.broadcast(table), F.col(f"{into}_hash") == F.col(f"{into}_gram"), "left"
        ).drop(f"{into}_hash", f"{into}_gram")

    voted = joined(joined(rolled, phrases, PHRASE_GRAM, "base"), notices, NOTICE_GRAM, "own")
    # a document's first word stays for the document itself
    kept = write_once(
        voted.filter("pos is null or pos = 0 or base is not null or own is not null")
    )

    texts = kept.filter("pos is null or pos = 0").groupBy("doc_id", "version").agg(
        F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words")
    )
    window = F.array(*(F.col(f"w{i}") for i in range(NOTICE_GRAM)))
    votes = (
        kept.filter("base is not null or own is not null")
        .select(
            "doc_id", "version", "pos", window.alias("window"),
            F.explode(
                F.concat(
                    *(F.coalesce(c, F.array().cast(kept.schema["base"].dataType)) for c in ("base", "own"))
                )
            ).alias("p"),
        )
        .filter(F.slice("window", F.lit(1), F.col("p.k")) == F.col("p.words"))
        .select(
            "doc_id", "version", "p.k", "p.template", "p.label", "p.grams", "p.at",
            (F.col("pos") - F.col("p.at")).alias("diagonal"),
        )
        .distinct()
    )
    template = ("doc_id", "version", "k", "template", "label", "grams")
    diagonals = votes.groupBy(*template, "diagonal").agg(F.collect_set("at").alias("at"))
    order = Window.partitionBy(*template).orderBy("diagonal")
    slack = F.when(F.col("k") == PHRASE_GRAM, 0).otherwise(SLACK)
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    merged = (
        diagonals.withColumn("fresh", fresh.cast("int"))
        .withColumn("place", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*template, "place")
        .agg(
            F.min("diagonal").cast("long").alias("start"),
            (F.size(F.array_distinct(F.flatten(F.collect_list("at")))) / F.first("grams")).alias("share"),
        )
    )
    base = F.col("k") == PHRASE_GRAM
    accepted = merged.filter(F.col("share") >= F.when(base | (F.col("grams") <= FEW), 1.0).otherwise(LEAST))

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(labels)), ",")

    found = accepted.groupBy("doc_id", "version").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    same = texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["version"] == found["version"])
    return texts.join(found, same, "left").select(
        texts["doc_id"], "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
