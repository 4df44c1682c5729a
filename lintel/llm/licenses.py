"""License scans: an exact set-similarity join of text blocks against licence templates.

A document meets a template if some L consecutive words of it (L the words of the longest template,
cut as the contract cuts them) hold at least ``threshold`` of the template's distinct words. Texts
are cut in overlapping blocks (2L words, stride L), so every L consecutive words lie whole in
some block, and blocks are joined with templates. The join is exact:

* tokens are ordered by their global document frequency over all documents, rarest first;
* prefix filter: a template can only be met by a block that shares one of the template's first
  |t| - ceil(threshold |t|) + 1 tokens and has it among its own first |b| - need + 1 tokens;
* length filter: the block's template tokens must be at least ``need`` many;
* positional filter: from the first shared token on, both sides must still hold ``need`` tokens.

Survivors are verified word by word: L consecutive words of the block must hold the tokens. Only the
tokens of templates can overlap, so blocks are joined by those. Templates are a fixed list, which
bounds what is broadcast.

Scale: documents are scanned once and never shuffled; what is kept of them are counts, the template
tokens they hold and their candidate blocks. What moves is (row key, template) of the hits.

Edge cases: a null or empty text has no words, score 0 and empty labels; texts shorter than a
block are one block; a very long text is as many blocks as it needs; rows that repeat id and text
get equal results; a null id is kept; columns besides doc_id and text are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import ascii_lower, row_key
from lintel.plans.storage import materialize

#: Fixed value: the word pattern of the contract.
TOKEN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Passages of public licence notices, by the label they stand for.
TEMPLATES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2.0-notice": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "agpl-notice": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or any later version",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
    "cc-by-notice": "this work is licensed under the creative commons attribution 4.0 international license to view a copy of this license visit http creativecommons org licenses by 4.0",
    "unlicense-notice": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial",
    "warranty-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _template_sets(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    found = {label: list(dict.fromkeys(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()))) for label, text in templates.items()}
    return {label: tokens for label, tokens in found.items() if tokens}


def longest(templates: dict[str, str]) -> int:
    """The words of the longest template, by the contract's pattern."""
    import re

    return max((len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())) for text in templates.values()), default=1) or 1


def _literals(tokens: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in tokens])


class _Templates:
    """The template list: token sets, what each must share, and the block span."""

    def __init__(self, templates: dict[str, str] | None, threshold: float):
        texts = TEMPLATES if templates is None else templates
        self.sets = _template_sets(texts)
        self.need = {label: math.ceil(threshold * len(tokens) - 1e-9) for label, tokens in self.sets.items()}
        self.vocabulary = sorted({t for tokens in self.sets.values() for t in tokens})
        self.span = longest(texts)
        self.least = min(self.need.values(), default=1)


def _facts(docs: DataFrame, t: _Templates, phrases: dict[str, str]) -> DataFrame:
    """One scan that cuts every text in words once: counts, phrase places, the template tokens a
    document holds, and its blocks with enough of them (length filter). Texts stay behind."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    likely = F.lit(False)
    for word in sorted({p.split()[-1] for p in phrases}):
        likely = likely | text.contains(word)
    vocabulary = _literals(t.vocabulary) if t.vocabulary else F.array().cast("array<string>")
    none = F.array().cast("array<struct<at:bigint,label:string>>")

    def cut(ws: Column) -> Column:
        last = F.greatest(F.ceil((F.size(ws) - t.span) / F.lit(t.span)) - 1, F.lit(0)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("block"), F.array_intersect(F.slice(ws, i * t.span + 1, 2 * t.span), vocabulary).alias("bt")))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.when(F.col("likely"), phrase_places(ws, phrases) if phrases else none).otherwise(none).alias("places"),
            F.array_intersect(ws, vocabulary).alias("held"),
            F.transform(F.filter(blocks, lambda b: F.size(b["bt"]) >= t.least), lambda b: F.struct(b["block"], b["bt"], F.slice(ws, b["block"] * t.span + 1, 2 * t.span).alias("words"))).alias("blocks"),
        )

    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rid"), "text", likely.alias("likely"))
    facts = rows.select("doc_id", "rid", F.transform(F.array(words_of(F.col("text"))), cut)[0].alias("f"))
    return materialize(facts.select("doc_id", "rid", "f.*"), "licence-facts")


def token_order(facts: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template tokens by document frequency over all documents, rarest first.

    The result has at most one row per template token, a bound fixed by the template list.
    """
    found = facts.select(F.explode("held").alias("token"))
    counts = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def _matches(facts: DataFrame, t: _Templates) -> DataFrame:
    """The set-similarity join of blocks and templates."""
    spark = facts.sparkSession
    order = token_order(facts, t.vocabulary)
    rank = {token: i for i, token in enumerate(order)}
    rows = []
    for label, tokens in t.sets.items():
        ordered, need = sorted(tokens, key=rank.__getitem__), t.need[label]
        rows += [(token, label, i, len(ordered), need, ordered) for i, token in enumerate(ordered[: len(ordered) - need + 1])]
    index = spark.createDataFrame(rows, "token string, label string, ti int, tn int, need int, tokens array<string>")
    blocks = facts.select("doc_id", "rid", F.explode("blocks").alias("b"))
    blocks = blocks.select("doc_id", "rid", F.col("b.block").alias("block"), F.col("b.words").alias("words"), F.array_intersect(_literals(order) if order else F.col("b.bt"), F.col("b.bt")).alias("bt"))
    probes = blocks.select("doc_id", "rid", "block", "words", "bt", F.posexplode(F.slice("bt", 1, F.size("bt") - t.least + 1)).alias("bi", "token"))
    # The template index is a fixed list of at most a few hundred rows.
    joined = probes.join(F.broadcast(index), "token").where(
        (F.size("bt") >= F.col("need")) & (F.col("bi") <= F.size("bt") - F.col("need")) & (F.least(F.col("tn") - F.col("ti"), F.size("bt") - F.col("bi")) >= F.col("need"))
    )
    met = joined.where(F.size(F.array_intersect("bt", "tokens")) >= F.col("need")).dropDuplicates(["doc_id", "rid", "block", "label"])
    # Consecutive words that start with a token of the template: others hold no more.
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains("tokens", F.col("words")[i]))
    passages = F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(F.slice("words", i + 1, t.span), "tokens")).alias("shared"), (-i).alias("at")))
    best = met.withColumn("best", F.array_max(passages)).where(F.col("best.shared") >= F.col("need"))
    hit = best.select("doc_id", "rid", "label", (F.col("best.shared") / F.col("tn")).alias("containment"), (F.col("block") * t.span - F.col("best.at")).cast("long").alias("first_word"))
    top = F.max(F.struct("containment", (-F.col("first_word")).alias("at"))).alias("top")
    return hit.groupBy("doc_id", "rid", "label").agg(top).select("doc_id", "rid", "label", (-F.col("top.at")).alias("first_word"), "top.containment")


def matching_passages(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, rid, label, first_word, containment) of every document that meets a template, with its first best passage."""
    t = _Templates(templates, threshold)
    return _matches(_facts(docs.select("doc_id", "text"), t, {}), t)


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """Array of struct(at, label): every place where a phrase's words stand consecutively."""

    def at(ws: Column, i: Column, parts: list[str]) -> Column:
        hit = F.lit(True)
        for j, part in enumerate(parts):
            hit = hit & F.coalesce(F.try_element_at(ws, i + 1 + j) == F.lit(part), F.lit(False))
        return hit

    def of(ws: Column, phrase: str, label: str) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ws)), lambda i: at(ws, i, phrase.split()))
        return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    def places(ws: Column) -> Column:
        return F.concat(*[of(ws, phrase, label) for phrase, label in phrases.items()])

    return F.transform(F.array(words), places)[0]


def license_report(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, phrases: dict[str, str] | None = None) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    phrases = PHRASES if phrases is None else phrases
    t = _Templates(templates, threshold)
    base = _facts(docs.select("doc_id", "text"), t, phrases)
    found = _matches(base, t).groupBy("doc_id", "rid").agg(F.collect_set("label").alias("met"), F.max("containment").alias("best"))
    base = base.select(
        "doc_id", "rid", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("named"),
    )
    f = found.select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid"), "met", "best")
    out = base.join(f, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rid") == F.col("_rid")), "left")
    every = F.array_sort(F.array_distinct(F.concat("named", F.coalesce(F.col("met"), F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("named", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.col("best"), F.lit(0.0))).alias("score"),
    )


def oracle(threshold: float = 0.8) -> str:
    """The same answer by sliding over every word of every document."""
    sets = _template_sets(TEMPLATES)
    span = longest(TEMPLATES)
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    values = ", ".join(f"('{label}', [{', '.join(repr(t) for t in tokens)}], {math.ceil(threshold * len(tokens) - 1e-9)})" for label, tokens in sets.items())
    places = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS pl, '{label}' AS label FROM e WHERE " + " AND ".join(f"ws[i + {j}] = '{part}'" for j, part in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}') AS ws
  FROM documents),
e AS (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM d WHERE list_contains(ws, 'license')),
p AS ({places}),
b AS (SELECT rid, count(*) AS n, min(pl) AS f, max(pl) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, list_distinct(list(label)) AS named FROM p GROUP BY rid),
t(label, tokens, need) AS (VALUES {values}),
v AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
x AS (SELECT label, need, len(tokens) AS n, unnest(tokens) AS w FROM t),
g AS (
  SELECT rid, label, need, n, count(DISTINCT v.w) OVER (PARTITION BY rid, label ORDER BY i RANGE BETWEEN CURRENT ROW AND {span - 1} FOLLOWING) AS held
  FROM v JOIN x ON v.w = x.w),
h AS (SELECT rid, label, max(held / CAST(n AS DOUBLE)) AS c FROM g WHERE held >= need GROUP BY rid, label),
m AS (SELECT rid, max(c) AS best, list(label) AS met FROM h GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base,
       CAST(b.f AS BIGINT) AS first_word, CAST(b.l AS BIGINT) AS last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.named, []), coalesce(m.met, [])))), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)
"""
