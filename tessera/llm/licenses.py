"""License texts by diagonal voting, in DataFrame functions only.

Every text is cut into words; the hash of every k-gram, rolled from word to word,
is joined to the hashes of the templates' k-grams (equal words are asked for
beside equal hashes; hashes that no template has are left out before rows are
made of them). A
match at word p of the text and word q of a template votes for the diagonal
p - q. Votes are counted by (text, template, diagonal); diagonals at most
``GAP`` apart (an inserted or dropped word shifts the diagonal) are merged; a
span is verified by the share of the template's k-grams that voted for it. A
phrase stands at a place exactly if all its k-grams vote for one diagonal.

Scale. The templates are a fixed few thousand k-grams, so the join is broadcast
and the k-grams of the corpus are never shuffled: counts of matches are made in
the task that read the text, and only these are. A k-gram that every text holds
costs a row a text.

Nulls, ties, repeats: a null, empty or wordless text has no words, no places
(null first and last), no labels and score 0. Rows come back one for one with
their id as it is (null, repeated). Extra columns are ignored. Equal labels of
several templates are given once. An empty table gives an empty result. A very
long text is an array of words in one row until its matches are counted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm.license_texts import TEXTS
from tessera.scratch import fewer_files

K = 3
GAP = 3
COVERED = 0.6
#: The share of a whole license or notice that must be there; many differ in a word or two.
WHOLE = 0.95
MASK = 63
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that count wherever their words stand one after another, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Passages of public licenses that are recognised when most of their words are there.
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "you may redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-text",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-text",
    "this source code form is subject to the terms of the mozilla public license": "mpl-text",
    "this work is licensed under a creative commons attribution": "cc-text",
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def _hash(words: list[Column]) -> Column:
    """Rolled: each word's hash starts from that of the words before it."""
    return F.xxhash64(*words)


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, passages: dict[str, str] = PASSAGES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """``(template, label, phrase, least, grams, at, gram, hash)``: a row for each k-gram of each template."""
    rows = []
    least = [0.0] * len(phrases) + [COVERED] * len(passages) + [WHOLE] * len(texts)
    for number, (text, label) in enumerate([*phrases.items(), *passages.items(), *((t, k) for k, t in texts.items())]):
        words = words_of(text)
        if len(words) < K:
            raise ValueError(f"a template takes at least {K} words, not {text!r}")
        rows += [(number, label, number < len(phrases), least[number], len(words) - K + 1, i, words[i : i + K]) for i in range(len(words) - K + 1)]
    named = spark.createDataFrame(rows, "template int, label string, phrase boolean, least double, grams int, at int, gram array<string>")
    return named.withColumn("hash", _hash([F.col("gram")[i] for i in range(K)]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, phrases: dict[str, str] = PHRASES, passages: dict[str, str] = PASSAGES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    known = templates(spark, phrases, passages, texts)
    hashes = [r.hash for r in known.select("hash").distinct().collect()]  # a fixed few thousand, see above
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.array_remove(F.split(text, SEPARATORS), "").alias("words"))
    n = F.size("words")
    places = F.when(n >= K, F.sequence(F.lit(1), n - (K - 1))).otherwise(F.array().cast("array<int>"))
    rolled = F.transform(places, lambda i: F.struct((i - 1).alias("place"), _hash([F.element_at("words", i + j) for j in range(K)]).alias("hash")))
    found = F.filter(rolled, lambda x: x["hash"].isin(hashes))
    found = F.transform(found, lambda x: F.struct(x["place"].alias("place"), x["hash"].alias("hash"), F.slice("words", x["place"] + 1, F.lit(K)).alias("gram")))
    # a place of no template keeps texts without matches
    none = F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<string>").alias("gram")))
    every = words.select("row", "id", n.cast("long").alias("n_words"), F.explode(F.concat(none, found)).alias("m")).select("row", "id", "n_words", "m.*")
    lone = spark.createDataFrame([(-1, "", False, 0.0, 1, 0, [], 0)], "template int, label string, phrase boolean, least double, grams int, at int, gram array<string>, hash long")
    votes = every.join(F.broadcast(known.unionByName(lone)), ["hash", "gram"])
    votes = votes.withColumn("diagonal", F.when(F.col("template") >= 0, F.col("place") - F.col("at")).otherwise(0))
    keys = ["row", "id", "n_words", "template", "label", "phrase", "least", "grams"]
    # places of a template that were voted for, as bits of as many words as the longest one takes
    masks = range(max((len(words_of(t)) - K for t in [*phrases, *passages, *texts.values()]), default=0) // MASK + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % MASK)
    seen = [F.bit_or(F.when(F.floor(F.col("at") / MASK) == m, bit).otherwise(F.lit(0).cast("long"))).alias(f"seen{m}") for m in masks]
    lines = votes.groupBy(*keys, "diagonal").agg(F.count("*").alias("votes"), *seen)

    beside = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(beside) > GAP, F.lit(True))
    spans = lines.withColumn("span", F.sum(apart.cast("int")).over(beside))
    whole = F.col("phrase") & (F.col("votes") == F.col("grams"))
    spans = spans.groupBy(*keys, "span").agg(
        sum((F.bit_count(F.bit_or(f"seen{m}")) for m in masks[1:]), F.bit_count(F.bit_or("seen0"))).alias("covered"),
        F.sum(whole.cast("long")).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).cast("long").alias("last_word"),
    )
    share = F.when(F.col("template") >= 0, F.col("covered") / F.col("grams")).otherwise(0.0)
    base = F.when(F.col("places") > 0, F.col("label"))
    label = F.when((F.col("template") >= 0) & (share >= F.col("least")) & (~F.col("phrase") | (F.col("places") > 0)), F.col("label"))
    out = spans.groupBy("row", "id", "n_words").agg(
        F.sum("places").alias("n_base"),
        F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.max(share).alias("score"),
    )
    return fewer_files(out).select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
