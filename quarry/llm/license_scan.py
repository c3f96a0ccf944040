"""License scan: an exact set-similarity join of word windows with license templates, in DataFrame functions.

The corpus frequency of every template word orders a template's distinct words, rarest first. A window as long as
the template holds at least `need` = ceil(threshold * words) of them only if it holds one of the first
words - need + 1 (the prefix). So only places of prefix words open windows (the index side is the template table, of
fixed size); the positional filter drops a place whose word leaves too few words after it in the order, the length
filter drops texts with too few words, and the overlap is counted once per remaining window. Templates
with threshold 1 are phrases: their words must also stand consecutively, which is checked word by word.

The frequencies are partial sums over all rows of a vocabulary as small as the templates; nothing else is shuffled and every row
is judged inside its own task.

The templates are a table of (text, label), as a list or as a DataFrame whose rows are counted before they are read (`MOST` at most,
as the template side is part of the plan). NOTICES below is the default one.

A window's best place needs no search over all starts: moving a start right to the next template word loses no template word, so only
starts at template words are looked at, each once.

Cases: null or wordless text has n_words 0, n_base 0, empty labels, score 0 and null first and last words; overlapping places
all count; a text shorter than a template is one window; templates without words take no part; repeated rows each give a row; texts are
read whole, at a cost linear in their length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters as WORD without a negated class, which Java matches several times slower.
WORD_JAVA = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8

#: Base phrases (all words, consecutive) and their labels.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: The method's own templates (a share of THRESHOLD of the words within a window) and their labels.
NOTICES = (
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-grant"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "mit-body",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        "isc-body",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-grant"),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
        "bsd-conditions",
    ),
    (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
        "other liability",
        "warranty-disclaimer",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0-notice"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at",
        "apache-2.0-header",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0-notice"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",
        "gpl-header",
    ),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-notice"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0-notice"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license",
        "bsl-1.0-grant",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
        "from the use of this software permission is granted to anyone to use this software for any purpose",
        "zlib-grant",
    ),
)
MOST = 200


def templates(table) -> list[tuple[str, str]]:
    """(text, label) pairs of a list or of a DataFrame(text, label); texts become their words."""
    if isinstance(table, DataFrame):
        rows = table.where("text is not null and label is not null").select("text", "label").limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"more than {MOST} templates")
        table = sorted((r.text, r.label) for r in rows)
    lower = str.maketrans(UPPER, LOWERED)
    pairs = [(" ".join(re.findall(WORD, text.translate(lower))), label) for text, label in table]
    return [(text, label) for text, label in pairs if text]


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() only where every character is one byte: then it changes A-Z alone.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWERED))
    # Not a split, whose Java strings would double the memory of a long text.
    return F.regexp_extract_all(low, F.lit(WORD_JAVA), F.lit(0))


def _frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Occurrences of the template words over all rows; as many values as the templates have words."""
    one = docs.select(F.explode(words_of(F.col("text"))).alias("w")).where(F.col("w").isin(vocabulary))
    return {r["w"]: r["n"] for r in one.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _template(text: str, label: str, threshold: float, order: dict[str, int]) -> dict:
    phrase = text.split()
    ranked = sorted(set(phrase), key=lambda w: (order.get(w, 0), w))
    need = ceil(threshold * len(ranked))
    return {"label": label, "phrase": phrase, "tokens": ranked, "need": need, "prefix": ranked[: len(ranked) - need + 1]}


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan(docs: DataFrame, base=BASE, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) with n_words, places (array of struct<label, start> of phrases) and found (struct<label, score> of notices)."""
    base, notices = templates(base), templates(notices)
    vocabulary = sorted({w for t, _ in (*base, *notices) for w in t.split()})
    order = _frequencies(docs, vocabulary)
    phrases = [_template(t, label, 1.0, order) for t, label in base]
    windows = [_template(t, label, threshold, order) for t, label in notices]
    prefix = sorted({w for t in (*phrases, *windows) for w in t["prefix"]})
    rows = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    n = F.size("w")
    rows = rows.select("doc_id", "w", n.cast("long").alias("n_words"), F.arrays_overlap("w", _strings(prefix)).alias("any"))
    at = F.when(F.col("any"), F.filter(F.sequence(F.lit(0), F.col("n_words").cast("int") - 1), lambda i: F.get("w", i).isin(prefix)))
    rows = rows.select("doc_id", "w", "n_words", F.coalesce(at, F.array().cast("array<int>")).alias("at"))

    def phrase_places(t: dict) -> Column:
        rare, k = t["prefix"][0], len(t["phrase"])
        offset = t["phrase"].index(rare)
        # The rare word's first place in the phrase fixes the start, so each start comes once.
        starts = F.transform(F.filter("at", lambda i: F.get("w", i) == rare), lambda i: i - offset)
        fits = F.filter(starts, lambda s: (s >= 0) & (F.slice("w", F.greatest(s + 1, F.lit(1)), k) == _strings(t["phrase"])))
        return F.transform(fits, lambda s: F.struct(F.lit(t["label"]).alias("label"), s.cast("long").alias("start")))

    def window_score(t: dict) -> Column:
        k, need, tokens = len(t["phrase"]), t["need"], t["tokens"]

        ahead = [w for r, w in enumerate(tokens) if w in t["prefix"] and len(tokens) - r >= need]
        opened = F.filter("at", lambda i: F.get("w", i).isin(ahead))

        def fresh(i: Column, before: Column) -> Column:
            # Starts of windows that hold place i but not the place before it.
            return F.filter(F.sequence(F.greatest(i - (k - 1), before + 1), i), lambda s: F.get("w", s).isin(tokens))

        before = F.slice(F.concat(F.array(F.lit(-1)), opened), 1, F.size(opened))
        starts = F.flatten(F.zip_with(opened, before, fresh))
        top = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(F.slice("w", s + 1, k), _strings(tokens)))))
        top = F.when((F.col("n_words") >= need) & (F.size(opened) > 0), top)
        return F.struct(F.lit(t["label"]).alias("label"), F.when(top >= need, top / F.lit(float(len(tokens)))).alias("score"))

    places = F.concat(*[phrase_places(t) for t in phrases]) if phrases else F.array().cast("array<struct<label:string,start:bigint>>")
    found = F.filter(F.array(*[window_score(t) for t in windows]), lambda x: x["score"].isNotNull()) if windows else F.array()
    none = F.array().cast("array<struct<label:string,start:bigint>>")
    hit = F.size("at") > 0
    return rows.select(
        "doc_id",
        "n_words",
        F.when(hit, places).otherwise(none).alias("places"),
        F.when(hit, found).otherwise(F.array().cast("array<struct<label:string,score:double>>")).alias("found"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    own = F.transform("found", lambda p: p["label"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda p: p["score"])), F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """All windows of all texts, without filters."""
    bases = ", ".join(f"('{label}', {t.split()})" for t, label in BASE)
    sets = ", ".join(f"('{label}', {sorted(set(t.split()))}, {len(t.split())}, {ceil(THRESHOLD * len(set(t.split())))})" for t, label in NOTICES)
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWERED}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
base(label, phrase) AS (VALUES {bases}),
p AS (SELECT rid, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS start FROM d, base),
pb AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS ls FROM p GROUP BY rid),
sets(label, tokens, k, need) AS (VALUES {sets}),
s AS (SELECT rid, label, list_max(list_transform(range(greatest(len(w) - k, 0) + 1), lambda i: len(list_intersect(w[i + 1:i + k], tokens)))) AS top, need, len(tokens) AS m FROM d, sets WHERE len(list_intersect(list_distinct(w), tokens)) >= need),
sb AS (SELECT rid, list(label) AS ls, max(top / m::DOUBLE) AS score FROM s WHERE top >= need GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(pb.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(pb.ls, []), coalesce(sb.ls, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN pb USING (rid) LEFT JOIN sb USING (rid)
"""


ORACLE = _oracle()
