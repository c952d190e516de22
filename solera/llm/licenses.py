"""License scan by diagonal voting (operator 12).

A license notice is found where a document's words run along a template's:

1. The rolling ``GRAM``-word hashes of every document are joined to those of the templates (a
   fixed list, broadcast).  A hit at word p of the document and t of the template votes for the
   diagonal p - t.
2. Votes are added up by diagonal.  A phrase counts where one diagonal has all its votes and the
   words are the phrase's: a *place*.
3. A notice may be changed in up to a fifth of its words, so that its votes lie on neighbouring
   diagonals: windows of neighbouring ones are merged, each overlapping the next by half, so that
   the diagonals of one place always lie in one window together.  A window with fewer votes than
   such a place must have is out (each changed word takes away ``GRAM`` of them at most).
4. The words along each window left are verified by their least number of edits to the template;
   at a similarity (1 - edits / words) of ``SIMILAR`` or more they are a *span*.
5. Where spans overlap, each word goes to the best one (similarity, words, label); a span that
   keeps no half of its words goes, so that a notice doesn't count for its look-alikes.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z taken as
a-z.  Hits are found by hashes of lower-cased words and verified by the words themselves.

Defined cases: a null text is an empty one, without words, places or labels, score 0; rows with
the same id and text are one document, each with its row; null ids are kept apart by their texts;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solera.llm.common import text_of, written

GRAM = 3
SIMILAR = 0.8
#: What separates words.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# --- fixed values: phrases of the base rule, (label, words) --------------------------------
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# --- fixed values: the wording of common license notices, (label, text) --------------------
NOTICES = [
    ("all-rights-reserved", "All rights reserved"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
# -------------------------------------------------------------------------------------------


def words_of(text: F.Column) -> F.Column:
    return F.array_remove(F.split(text_of(text), APART, -1), "")


def _with_grams(df: DataFrame, gram: int) -> DataFrame:
    """``df`` (words) with the hashes of its rolling grams."""
    df = df.withColumn("__h", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    run = ", ".join(f"__h[i + {k}]" for k in range(gram))
    return df.withColumn("grams", F.expr(f"if(size(__h) >= {gram}, transform(sequence(0, size(__h) - {gram}), i -> xxhash64({run})), array())")).drop("__h")


def edits_allowed(words: int, similar: float = SIMILAR) -> int:
    """Edits of the least similar span of so many words."""
    return int(words * (1 - similar) + 1e-9)


def template_grams(spark: SparkSession, phrases, notices, gram: int = GRAM, similar: float = SIMILAR) -> DataFrame:
    """(template, phrase, m, slack, need, at, h): each position of each template with its gram's
    hash, the number of its words, the edits allowed and the votes needed."""
    rows = [(k, label, k < len(phrases), text) for k, (label, text) in enumerate([*phrases, *notices])]
    df = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string")
    df = _with_grams(df.withColumn("words", F.transform(words_of(F.col("text")), lambda w: F.translate(w, UPPER, LOWER))), gram)
    m = F.size("words")
    slack = F.when(F.col("phrase"), 0).otherwise(F.floor(m * F.lit(1 - similar) + F.lit(1e-9))).cast("int")
    need = F.greatest(F.lit(1), m - gram + 1 - gram * slack)
    return df.withColumn("slack", slack).withColumn("need", need).select("template", "phrase", m.alias("m"), "slack", "need", F.posexplode_outer("grams").alias("at", "h"))


KEY = ["has_id", "id", "text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents without nulls in their key."""
    text = text_of(F.col("text"))
    return docs.select(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"),
                       F.xxhash64(text).alias("text_hash"), text.alias("text"))


def windows(docs: DataFrame, phrases, notices, gram: int = GRAM, similar: float = SIMILAR) -> DataFrame:
    """KEY, windows: the windows of diagonals that have the votes their template needs, each with
    its first word and the number of words along it.

    Window w of a template with slack s holds the diagonals from w * (s + 1) on, twice s + 1 of
    them; a phrase's holds one."""
    # Only the key goes with each gram: words would be copied for every one.  The outer form, as
    # the plain one adds a filter on the grams' number that works out every word for every gram.
    grams = (_with_grams(_keyed(docs).withColumn("words", words_of(F.col("text"))), gram)
             .select(*KEY, F.posexplode_outer("grams").alias("pos", "h")))
    met = grams.join(F.broadcast(template_grams(docs.sparkSession, phrases, notices, gram, similar)), "h")
    step, diagonal = F.col("slack") + 1, F.col("pos") - F.col("at")
    first = F.floor(diagonal / step).cast("int")
    met = met.select(*KEY, "template", "need", "slack", "phrase", "m", F.struct("pos", "at").alias("vote"),
                     F.explode(F.when(F.col("phrase"), F.array(diagonal)).otherwise(F.array(first - 1, first))).alias("window"))
    voted = met.groupBy(*KEY, "template", "window", "need", "slack", "phrase", "m").agg(F.count_distinct("vote").alias("votes")).filter("votes >= need")
    start = F.col("window") * (F.col("slack") + 1)
    # from the window's first diagonal to its last and on through the template and its edits
    stop = F.when(F.col("phrase"), start + F.col("m")).otherwise(start + 2 * (F.col("slack") + 1) + F.col("m") + F.col("slack"))
    start = F.greatest(start, F.lit(0))
    voted = voted.filter(start < stop)
    return voted.groupBy(*KEY).agg(F.collect_list(F.struct("template", start.alias("start"), (stop - start).alias("n"))).alias("windows"))


def least_edits(own: list[str], along: list[str]) -> tuple[int, int, int]:
    """(edits, from, to): the run of ``along`` that takes the fewest edits to ``own``, the first
    to end of these, the shortest of those."""
    code: dict[str, int] = {}
    a = np.array([code.setdefault(w, len(code)) for w in own])
    b = np.array([code.setdefault(w, len(code)) for w in along])

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = steps * 0 if free else steps
        for n, x in enumerate(a, 1):
            best = np.concatenate(([n], np.minimum(row[:-1] + (b != x), row[1:] + 1)))
            row = np.minimum.accumulate(best - steps) + steps
        return row

    ends = last_row(a, b, True)
    stop = int(ends.argmin())
    back = last_row(a[::-1], b[:stop][::-1], False)
    return int(ends[stop]), stop - int(back.argmin()), stop


def judged(templates: list[tuple[str, list[str], bool]], similar: float = SIMILAR):
    """What a document's windows, (template, first word, words along it), come to: places of
    phrases and verified spans."""
    verified: dict[tuple, tuple] = {}

    def verify(template: int, along: tuple[str, ...]) -> tuple[int, int, int]:
        if (template, along) not in verified:
            if len(verified) > 10_000:
                verified.clear()
            verified[template, along] = least_edits(templates[template][1], list(along))
        return verified[template, along]

    def judge(found) -> dict:
        places, spans = [], set()
        for w in found:
            (label, own, phrase), along, start = templates[w["template"]], tuple(w["along"]), w["start"]
            if phrase:
                if list(along) == own:
                    places.append((start, label))
                continue
            edits, first, stop = verify(w["template"], along)
            if edits <= edits_allowed(len(own), similar):
                spans.add((1 - edits / len(own), stop - first, label, start + first, start + stop))
        best: dict[int, tuple] = {}
        for span in spans:
            for word in range(span[3], span[4]):
                best[word] = max(best.get(word, span), span)
        won: dict[tuple, int] = {}
        for span in best.values():
            won[span] = won.get(span, 0) + 1
        kept = sorted((s[3], s[4], s[2], s[0]) for s, n in won.items() if 2 * n >= s[1])
        base = {label for _, label in places}
        return {"n_base": len(places), "first_word": min(places)[0] if places else None, "last_word": max(places)[0] if places else None,
                "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s[2] for s in kept})),
                "score": 1.0 if places else max((s[3] for s in kept), default=0.0),
                "spans": [dict(zip(("first", "stop", "label", "similarity"), s, strict=True)) for s in kept]}

    return judge


_FOUND = pa.struct([("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("similarity", pa.float64())])))])
_FOUND_DDL = ("struct<n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,"
              "spans:array<struct<first:long,stop:long,label:string,similarity:double>>>")


def scanned(docs: DataFrame, phrases=tuple(PHRASES), notices=tuple(NOTICES), gram: int = GRAM, similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans (first, stop, label and similarity of each)."""
    templates = [(label, _WORD.findall(text.translate(str.maketrans(UPPER, LOWER))), k < len(phrases)) for k, (label, text) in enumerate([*phrases, *notices])]
    if min(len(own) for _, own, _ in templates) < gram:
        raise ValueError("a template has fewer words than a gram")
    voted = written(windows(docs, phrases, notices, gram, similar), "license-windows")

    @F.arrow_udf(_FOUND_DDL)
    def judge(found: pa.Array) -> pa.Array:
        one = judged(templates, similar)
        return pa.array([one(x or []) for x in found.to_pylist()], _FOUND)

    both = _keyed(docs).join(voted, KEY, "left").withColumn("words", words_of(F.col("text")))
    along = F.expr(f"transform(windows, w -> struct(w.template as template, w.start as start, "
                   f"transform(slice(words, w.start + 1, w.n), x -> translate(x, '{UPPER}', '{LOWER}')) as along))")
    both = both.select(F.when(F.col("has_id"), F.col("id")).alias("doc_id"), F.size("words").cast("long").alias("n_words"), judge(along).alias("f"))
    return both.select("doc_id", "n_words", "f.*")
