"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a window of BLOCK words, and windows overlap by half, so that a notice may wrap over lines: every run of BLOCK / 2
words of the whole text lies in a window.  A template matches a window that contains at least PERCENT of the template's
distinct words, or all of them if the template has fewer than SHORT, and if these stand close together and in the template's order: some
stretch of the window, as long as the template or half as long again, holds enough of them, their first places rising.  A template whose words are a part of another matching
template's is left out there: `licensed under CC BY-NC 4.0` is not `licensed under CC BY 4.0`.

1. The templates' words are counted over all documents and ordered rarest first (one global order).
2. *Prefix filter*: a window that misses at most m - t of a template's m words (t: the least overlap) has one of its m - t + 1
   rarest words.  Documents without any such word are not looked at again; windows meet templates only through them.
3. *Length filter*: the window has at least t of the vocabulary.  *Positional filter*: with the shared word at position i of the
   template and j of the window (both in global order), the overlap is at most min(i, j) + 1 + min of what follows.
4. What is left is verified, by its words and by their places; every window over the threshold is found.

Beside the blocks, fixed phrases are located by their words in the whole text (the base labels).  The templates are a
parameter of the operator: a list, not a table that grows with the corpus, so its prefix words are broadcast.

Rows: null text is empty: no words, no labels, score 0.  Rows are told apart by id and text, so rows that repeat an id get
their own result each.  Without any label: empty strings, and null positions without a phrase.  Very long texts are many
windows, looked at in one row.  An empty table gives an empty result.  Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words of a window; share of a template's words; templates of fewer words must be held whole.
BLOCK, PERCENT, SHORT = 64, 80, 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lengths of the stretch that holds a template's words, in hundredths of their number.
STRETCH = (100, 150)
#: Words of lower-cased text (fixed pattern).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased (fixed pattern).
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def listed(pattern: str) -> str:
    """The same pattern with the characters of its ranges one by one: Java looks single ones up in one table and tries ranges one after the other."""
    each = lambda m: "".join(f"\\x{c:02X}" for c in range(int(m[1], 16), int(m[2], 16) + 1))
    return re.sub(r"\\x(..)-\\x(..)", each, pattern)


#: Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates: (label, words as they stand in notices).
TEMPLATES = (
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("mit", "released under the MIT License"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "this source code form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc0", "dedicated to the public domain under CC0 1.0"),
    ("gpl", "this program is distributed in the hope that it will be useful, but without any warranty"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("epl", "made available under the terms of the Eclipse Public License"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved, no part of this may be reproduced without written permission"),
)


def words_of(template: str) -> list[str]:
    return list(dict.fromkeys(re.findall(WORD, template.translate(str.maketrans(UPPER, LOWER)))))


def least(m: int, percent: int) -> int:
    return m if m < SHORT else -(-m * percent // 100)


def stretches(m: int) -> list[int]:
    return [-(-m * s // 100) for s in STRETCH]


def in_order(block, ws, m: int, t: int):
    """Whether a stretch of the block holds t of the template's m words, their first places in the template's order."""

    def fits(start, size: int):
        part = F.slice(block, start, F.lit(size))
        places = F.transform(F.array_intersect(ws, part), lambda w: F.array_position(part, w))
        return (F.size(places) >= t) & (places == F.array_sort(places))

    return F.exists(F.sequence(F.lit(1), F.size(block)), lambda k: F.array_contains(ws, F.get(block, k - 1)) & (fits(k, stretches(m)[0]) | fits(k, stretches(m)[1])))


def wider(templates) -> list[list[int]]:
    """For each template, those whose words are all of its words and more."""
    sets = [set(words_of(t)) for _, t in templates]
    return [[k for k, other in enumerate(sets) if own < other] for own in sets]


def lowered(text):
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text):
    return F.regexp_extract_all(text, F.lit(listed(WORD)), F.lit(0))


def holds(text, test):
    """Whether the test holds for the lower-cased text, which is made once however often the test names it."""
    return F.exists(F.array(F.lower(F.coalesce(text, F.lit("")))), test)


def vocabulary_order(docs: DataFrame, text: str, templates) -> list[str]:
    """The templates' words, rarest first by the number of documents that hold them."""
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    held = F.array_intersect(words(F.lower(F.coalesce(F.col(text), F.lit("")))), F.lit(vocabulary))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()  # at most the vocabulary
    seen = {r["word"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def block_matches(docs: DataFrame, doc_id: str, text: str, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(id, same, block, label, containment): each window that contains a template, with the template's label; `same` is the
    hash of the text."""
    order = vocabulary_order(docs, text, templates)
    rank = {w: k for k, w in enumerate(order)}
    known = [(k, label, sorted(words_of(t), key=rank.get)) for k, (label, t) in enumerate(templates)]
    prefix = [(w, k, i, len(ws), least(len(ws), percent)) for k, _, ws in known for i, w in enumerate(ws[: len(ws) - least(len(ws), percent) + 1])]
    first = sorted({p[0] for p in prefix})
    may = holds(F.col(text), lambda low: reduce(or_, (F.contains(low, F.lit(w)) for w in first)))
    all_words, step = words(lowered(F.col(text))), BLOCK // 2
    lines = docs.where(may).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("same"), all_words.alias("all"))
    last = F.greatest(F.lit(0), F.ceil((F.size("all") - BLOCK) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("all", k * step + 1, BLOCK))
    lines = lines.select("id", "same", F.posexplode(windows).alias("line", "block"))
    held = F.array_intersect(F.lit(order), F.col("block"))
    lines = lines.select("id", "same", "line", "block", held.alias("held")).where((F.size("held") >= min(p[4] for p in prefix)) & F.arrays_overlap("held", F.lit(first)))
    spark = docs.sparkSession
    lists = F.broadcast(spark.createDataFrame(prefix, "word string, template int, i int, m int, t int"))  # a few words of each template
    met = lines.select("id", "same", "line", "block", "held", F.posexplode("held").alias("j", "word")).join(lists, "word")
    overlap = F.least("i", "j") + 1 + F.least(F.col("m") - F.col("i") - 1, F.size("held") - F.col("j") - 1)
    met = met.where((F.size("held") >= F.col("t")) & (overlap >= F.col("t")))
    # A pair is verified at the first prefix word that its line holds.
    wholes = F.create_map(*[x for k, _, ws in known for x in (F.lit(k), F.lit(ws))])
    labels = F.create_map(*[x for k, label, _ in known for x in (F.lit(k), F.lit(label))])
    shared = F.array_intersect(F.col("held"), wholes[F.col("template")])
    met = met.withColumn("shared", shared).where((F.element_at("shared", 1) == F.col("word")) & (F.size("shared") >= F.col("t")))
    placed = F.lit(False)
    for k, (_, template) in enumerate(templates):
        ws = words_of(template)
        placed = F.when(F.col("template") == k, in_order(F.col("block"), F.lit(ws), len(ws), least(len(ws), percent))).otherwise(placed)
    met = met.where(placed)
    found = met.groupBy("id", "same", "line").agg(F.collect_set(F.struct("template", (F.size("shared") / F.col("m")).alias("containment"))).alias("hits"))
    more = F.create_map(*[x for k, ws in enumerate(wider(templates)) for x in (F.lit(k), F.lit(ws) if ws else F.array().cast("array<int>"))])
    best = F.filter("hits", lambda h: ~F.exists("hits", lambda o: F.array_contains(more[h["template"]], o["template"])))
    return found.select("id", "same", F.col("line").alias("block"), F.explode(best).alias("hit")).select("id", "same", "block", labels[F.col("hit.template")].alias("label"), "hit.containment")


def phrase_places(all_words, phrase: str):
    """Starts (words from 0) of the places where the phrase's words stand consecutively."""
    parts = phrase.split()

    def at(word, i):
        fits = word == parts[0]
        for k, p in enumerate(parts[1:], 1):
            fits = fits & (F.get(all_words, i + k) == p)
        return F.when(fits, i)

    return F.array_compact(F.transform(all_words, at))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks) for every row of docs."""
    matches = block_matches(docs, doc_id, text, templates, percent)
    found = matches.groupBy(F.col("id").alias("its_id"), F.col("same").alias("its_same")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.count_distinct("block").alias("n_blocks"))
    # A document with the phrase has all of its words somewhere.
    may = holds(F.col(text), lambda low: reduce(or_, (reduce(and_, (F.contains(low, F.lit(w)) for w in p.split())) for p in phrases)))
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("same"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(listed(RAW_WORD))).cast("long").alias("n_words"),
        F.when(may, words(lowered(F.col(text)))).alias("words"),
    )
    base = base.select("doc_id", "same", "n_words", *(phrase_places(F.col("words"), p).alias(f"at_{k}") for k, p in enumerate(phrases)))
    places = F.flatten(F.array(*(F.coalesce(F.col(f"at_{k}"), F.array().cast("array<int>")) for k in range(len(phrases)))))
    own = F.array_compact(F.array(*(F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values()))))
    base = base.select("doc_id", "same", "n_words", places.alias("places"), own.alias("own"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("its_id")) & F.col("same").eqNullSafe(F.col("its_same")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("own") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))


def oracle(templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT) -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    more = wider(templates)
    rows = ", ".join(f"({k}, '{label}', {quoted(words_of(t))}, {least(len(words_of(t)), percent)}, {more[k]}::INT[], {stretches(len(words_of(t)))})" for k, (label, t) in enumerate(templates))
    part = "block[i : i + size - 1]"
    at = f"list_transform(list_filter(ws, lambda w: list_contains({part}, w)), lambda w: list_position({part}, w))"
    placed = f"EXISTS (SELECT 1 FROM (SELECT {at} AS places FROM (SELECT unnest(range(1, 1 + len(block))) AS i), (SELECT unnest(sizes) AS size)) WHERE len(places) >= least AND places = list_sort(places))"
    places = ", ".join(
        "list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split())) + f") AS at_{n}"
        for n, phrase in enumerate(phrases)
    )
    flat = " || ".join(f"at_{n}" for n in range(len(phrases)))
    own = " || ".join(f"(CASE WHEN len(at_{n}) > 0 THEN ['{label}'] ELSE [] END)" for n, label in enumerate(phrases.values()))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
templates AS (SELECT * FROM (VALUES {rows}) AS t(k, label, ws, least, more, sizes)),
ws AS (SELECT r, doc_id, regexp_extract_all(low, '{WORD}') AS w FROM docs),
numbered AS (SELECT r, w, unnest(range(0, 1 + CAST(greatest(0, ceil((len(w) - {BLOCK}) / {BLOCK // 2})) AS BIGINT))) AS line FROM ws),
blocks AS (SELECT r, line, w[line * {BLOCK // 2} + 1 : line * {BLOCK // 2} + {BLOCK}] AS block FROM numbered),
near_hits AS (SELECT *, len(list_intersect(ws, block)) / len(ws) AS containment FROM blocks, templates WHERE len(list_intersect(ws, block)) >= least),
all_hits AS (SELECT r, line, k, label, more, containment FROM near_hits WHERE {placed}),
hits AS (SELECT * FROM all_hits h WHERE NOT EXISTS (SELECT 1 FROM all_hits o WHERE o.r = h.r AND o.line = h.line AND list_contains(h.more, o.k))),
found AS (SELECT r, list(DISTINCT label) AS found, max(containment) AS best, count(DISTINCT line) AS n_blocks FROM hits GROUP BY r),
spots AS (SELECT r, doc_id, len(w) AS n_words, {places} FROM ws),
base AS (SELECT r, doc_id, n_words, {flat} AS places, {own} AS own FROM spots)
SELECT doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  coalesce(list_aggregate(list_sort(list_distinct(own)), 'string_agg', ','), '') AS base_labels,
  coalesce(list_aggregate(list_sort(list_distinct(own || coalesce(found, []))), 'string_agg', ','), '') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM base LEFT JOIN found USING (r)
"""


OP1_SQL = oracle()
