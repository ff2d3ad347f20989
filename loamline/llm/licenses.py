"""License scans by an exact set-similarity join of text blocks and license templates. DataFrame functions only.

Words are runs of letters and digits, A-Z lower-cased. A template of h words (4 at least) is looked for in blocks of 2h words that
begin at every h-th word, so every passage of h words lies whole in a block. A block meets a template if it holds at least
`threshold` of the template's distinct words, its key words among them.

The join: words of templates are ordered by their count in all texts, rare ones first. A block that meets a template of n words
holds a = ceil(threshold n) of them, so one is among the template's first n - a + 1 (prefix). Only these words are joined with the
texts. A block with fewer than a words of any template goes (length), and so does one in which the shared word stands so late in
the order that fewer than a are left from there on (position). What remains is verified on the sets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.8
#: Templates and the order of their words go to all tasks, so their words are bounded.
MOST_WORDS = 4096

#: Phrases whose places are counted, by label.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Fixed values: (label, key words, text) of usual license notices, from the public texts of the licenses.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license see the license file for details"),
    ("mit", "permission copy modify", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "gnu general public 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "gnu general public 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "gnu lesser", "licensed under the gnu lesser general public license"),
    ("agpl", "affero", "licensed under the gnu affero general public license"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("bsd", "redistribution source binary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text with one space between, before and after them; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    # texts of ASCII alone take the faster function, which would change other letters too
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _BETWEEN, " ")), F.lit(" "))


def word_list(spaced_text: Column) -> Column:
    return F.array_remove(F.split(F.trim(spaced_text), " "), "")


def places(spaced_text: Column, words: Column, phrase: str) -> Column:
    """The numbers of the words at which a phrase begins; only texts that hold it are gone through."""
    parts = phrase.split()
    at = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: F.slice(words, i + 1, len(parts)) == F.array(*map(F.lit, parts)))
    return F.when(spaced_text.contains(f" {phrase} "), at).otherwise(F.array().cast("array<int>"))


def _sets(templates: Sequence[tuple[str, str, str]], threshold: float) -> list[tuple]:
    """(template, label, keys, distinct words, how many of them a block needs, half a block's length)."""
    rows = []
    for n, (label, keys, text) in enumerate(templates):
        words, keys = text.split(), keys.split()
        tokens = sorted({*words, *keys})
        if tokens:
            rows.append((n, label, keys, tokens, max(1, math.ceil(threshold * len(tokens) - 1e-9)), max(4, len(words))))
    if sum(len(r[3]) for r in rows) > MOST_WORDS:
        raise ValueError(f"templates of over {MOST_WORDS} words")
    return rows


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(_digest(text_col), word_list(spaced(F.col(f"`{text_col}`"))).alias("w"))


def _digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("digest")


def word_order(docs: DataFrame, text_col: str, words: set[str]) -> list[str]:
    """The words by their count in all texts, rare ones first, then by the words. There are MOST_WORDS at most."""
    asked = docs.sparkSession.createDataFrame([(w,) for w in words], "word string")
    # an outer explode, as Spark would else infer a filter that splits every text twice
    counted = _texts(docs, text_col).select(F.posexplode_outer("w").alias("p", "word")).join(F.broadcast(asked), "word").groupBy("word").count()
    counts = {r["word"]: r["count"] for r in counted.collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def blocks_found(docs: DataFrame, text_col: str = "text", templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(digest, template, label, first, words, containment): all blocks of texts (by the MD5 of the text, so equal texts are one) that
    meet a template, from word `first`, `words` words long."""
    sets = _sets(templates, threshold)
    order = word_order(docs, text_col, {w for r in sets for w in r[3]})
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for template, label, keys, words, need, half in sets:
        tokens = sorted(words, key=rank.__getitem__)
        # a prefix word lies in two blocks: the one that begins last before it and the one before that
        index += [(w, i, back, template, label, keys, tokens, need, half) for i, w in enumerate(tokens[: len(tokens) - need + 1]) for back in (0, 1)]
    index = docs.sparkSession.createDataFrame(index, "word string, i int, back int, template int, label string, keys array<string>, tokens array<string>, need int, half int")
    hits = _texts(docs, text_col).select("digest", "w", F.posexplode_outer("w").alias("p", "word")).join(F.broadcast(index), "word")
    hits = hits.withColumn("first", ((F.floor(F.col("p") / F.col("half")) - F.col("back")) * F.col("half")).cast("int")).where("first >= 0")
    hits = hits.withColumn("block", F.slice("w", F.col("first") + 1, 2 * F.col("half")))
    hits = hits.withColumn("held", F.array_intersect(F.lit(order) if order else F.array().cast("array<string>"), "block"))
    left = F.least(F.size("tokens") - F.col("i"), F.size("held") - F.array_position("held", F.col("word")).cast("int") + 1)
    hits = hits.where(F.size("held") >= F.col("need")).where(left >= F.col("need")).withColumn("both", F.array_intersect("tokens", "held"))
    # of a block's shared words the first stands for it
    hits = hits.where((F.size("both") >= F.col("need")) & (F.get("both", F.lit(0)) == F.col("word")) & (F.size(F.array_except("keys", "both")) == 0))
    return hits.select("digest", "template", "label", "first", F.size("block").alias("words"), (F.size("both") / F.size("tokens")).alias("containment")).distinct()


def scanned(docs: DataFrame, text_col: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with columns prefixed license_: n_words, n_base (places of phrases), first_word and last_word (the smallest and largest
    of their starts, null without any), base_labels and labels (with those of templates; distinct, sorted, comma-joined), score (1
    with a phrase, else the highest containment of a template that a block meets, 0 without) and blocks (the blocks that meet a
    template, in order).

    A null text counts as an empty one: no words, no labels, score 0. Equal texts are scanned alike; rows are neither merged nor
    dropped, whatever their ids. Columns of docs keep their names and values, unless they are named like a result, which takes
    their place. An empty table gives an empty one."""
    own = [c for c in docs.columns if c not in RESULTS]
    found = blocks_found(docs, text_col, templates, threshold)
    block = F.struct("first", "words", "label", "template", "containment")
    found = written(found.groupBy("digest").agg(F.array_sort(F.collect_list(block)).alias("blocks")), "licenses")
    d = docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in own)).alias("own"), _digest(text_col), spaced(F.col(f"`{text_col}`")).alias("s"))
    d = d.withColumn("w", word_list(F.col("s")))
    at = [(label, places(F.col("s"), F.col("w"), phrase)) for label, phrase in phrases.items()]
    starts = F.flatten(F.array(F.array().cast("array<int>"), *(x for _, x in at)))
    base = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.col("s").contains(f" {phrase} "), label) for label, phrase in phrases.items())))
    d = d.select("own", "digest", F.size("w").cast("long").alias("n_words"), starts.alias("at"), F.array_sort(F.array_distinct(base)).alias("base"))
    d = d.join(found, "digest", "left")
    of_blocks = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>"))
    labels = F.array_sort(F.array_distinct(F.concat("base", of_blocks)))
    most = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    values = [F.col("n_words"), F.size("at").cast("long"), F.array_min("at").cast("long"), F.array_max("at").cast("long"), F.array_join("base", ","), F.array_join(labels, ","), F.when(F.size("base") > 0, 1.0).otherwise(most), F.coalesce("blocks", F.array().cast(found.schema["blocks"].dataType))]
    return d.select(*(F.col("own")[c].alias(c) for c in own), *(x.alias(c) for x, c in zip(values, RESULTS)))


RESULTS = [f"license_{x}" for x in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")]


def _values() -> str:
    quoted = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"
    return ", ".join(f"({n}, '{label}', {quoted(keys)}, {quoted(tokens)}, {need}, {half})" for n, label, keys, tokens, need, half in _sets(TEMPLATES, THRESHOLD))


#: DuckDB SQL for the scan: phrases at every word, and every block of texts with a template's key words.
SQL = rf"""
WITH t(template, label, keys, tokens, need, half) AS (VALUES {_values()}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f(label, f) AS (VALUES {", ".join(f"('{k}', {v.split()})" for k, v in PHRASES.items())}),
p AS (SELECT r, label, i FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d) x, f WHERE w[(i + 1):(i + len(f))] = f),
c AS (SELECT r, w, t.* FROM d JOIN t ON list_has_all(w, keys)),
b AS (SELECT c.* EXCLUDE w, w[(k * half + 1):(k * half + 2 * half)] AS block FROM (SELECT *, unnest(range((len(w) + half - 1) // half)) AS k FROM c) c),
m AS (SELECT r, label, len(list_intersect(tokens, block)) AS shared, len(tokens) AS n, need FROM b WHERE list_has_all(block, keys)),
pa AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY r),
ma AS (SELECT r, max(shared / n) AS score FROM m WHERE shared >= need GROUP BY r),
la AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION SELECT r, label FROM m WHERE shared >= need) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM d LEFT JOIN pa USING (r) LEFT JOIN ma USING (r) LEFT JOIN la USING (r)
"""
