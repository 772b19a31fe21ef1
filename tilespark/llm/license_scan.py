"""License scans by a positional rare-token index, on DataFrame functions only.

The index holds, for each word of the licence templates below, its postings (template, position). Inverse document
frequencies of these words are counted over all documents. Each document looks up those licence words of its own that have
the highest IDF, ``FILE_WORDS`` of them; a posting at template position ``p`` and a document word at ``i`` agree on the
relative position ``i - p``, and a template is a candidate where enough of its words' IDF agrees on one. A candidate becomes a
label when its mandatory key phrases stand in the document. The templates, hence the index and every literal made of it, are
fixed and small.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, notice, mandatory key phrases. Short public notices and opening sentences.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published by the free software foundation",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mit-notice", "released under the mit license", ("released under the mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FILE_WORDS = 32
LEAST_SHARE = 0.6
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, notice, _ in templates for w in notice.split()})


def word_idf(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[str, float]:
    """IDF of each template word over all of ``docs``. As many entries as the templates have words, so a bounded collect."""
    each = docs.select(F.explode(F.array_intersect(words_of(lowered(F.col(text_col))), _strings(vocabulary(templates)))).alias("word"))
    counts = each.groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counts}
    n = docs.count()
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) + 1e-6 for w in vocabulary(templates)}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf: dict[str, float] | None = None, templates=TEMPLATES, file_words: int = FILE_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches``.

    ``matches`` are the verified templates as (label, start word, score). Null texts count as empty: no words, no labels,
    score 0, and null first and last word. Rows are decided each for itself, so ties and repeated rows change nothing, and
    columns other than id and text are not looked at. ``score`` is the share of a template's IDF that agrees at
    its best place, the largest of the verified templates, and at least 0.5 where a phrase of ``PHRASES`` stands.
    """
    idf = idf if idf is not None else word_idf(docs, text_col, templates)
    lower = F.col("__lower")
    base = docs.select(F.col(id_col).alias("doc_id"), lowered(F.col(text_col)).alias("__lower"))
    # Every label needs a key phrase, and every phrase its rarest word: documents with none of these hold no label.
    keys = sorted({max(p.split(), key=lambda w: (idf.get(w, 0.0), w)) for _, _, ps in templates for p in ps} | {max(p.split(), key=len) for p in PHRASES})
    short = [k for k in keys if len(k) <= 2]
    test = F.lit(False)
    for k in [k for k in keys if len(k) > 2]:
        test = test | F.contains(lower, F.lit(k))
    for k in short:
        test = test | (F.contains(lower, F.lit(k)) & lower.rlike(rf"(?<!{WORDS[:-1]}){re.escape(k)}(?!{WORDS[:-1]})"))
    gated = F.when(test, words_of(lower)).otherwise(F.array().cast("array<string>"))
    rows = base.select("doc_id", F.regexp_count(lower, F.lit(WORDS)).cast("long").alias("n_words"), gated.alias("w"))

    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: _phrase_at(i))
    starts = F.when(F.size("w") > 0, starts).otherwise(F.array().cast("array<int>"))
    first_words = {p.split()[0]: label for p, label in PHRASES.items()}
    named = F.create_map(*[F.lit(x) for pair in first_words.items() for x in pair])
    rows = rows.withColumn("starts", starts)
    rows = rows.withColumn("base", F.array_sort(F.array_distinct(F.transform("starts", lambda i: F.element_at(named, F.get(F.col("w"), i))))))

    rows = rows.withColumn("best", _best_places(idf, templates, file_words))
    text = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    rows = rows.withColumn("joined", F.when(F.size("w") > 0, text).otherwise(F.lit("")))
    verified = []
    for t, (label, notice, phrases) in enumerate(templates):
        weight = sum(idf[w] for w in sorted(set(notice.split())))
        place = F.element_at("best", t + 1)
        share = F.least(F.lit(1.0), place["weight"] / F.lit(weight))
        holds = share >= least_share
        for p in phrases:
            holds = holds & F.contains(F.col("joined"), F.lit(f" {p} "))
        verified.append(F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(label).alias("label"), place["start"].cast("long").alias("start"), share.alias("score"))))
    rows = rows.withColumn("matches", F.when(F.size("w") > 0, F.array_compact(F.array(*verified))).otherwise(F.array().cast("array<struct<label:string,start:bigint,score:double>>")))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("matches", lambda m: m["label"]))))
    score = F.greatest(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)), F.when(F.size("starts") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.get("starts", F.lit(0)).cast("long").alias("first_word"), F.get("starts", F.size("starts") - 1).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.round(score, 6).alias("score"), "matches",
    )


def _phrase_at(i: Column) -> Column:
    w, at = F.col("w"), F.lit(False)
    for phrase in PHRASES:
        here = F.lit(True)
        for k, word in enumerate(phrase.split()):
            here = here & F.coalesce(F.get(w, i + k) == word, F.lit(False))
        at = at | here
    return at


def _best_places(idf: dict[str, float], templates, file_words: int) -> Column:
    """Per template the relative position on which the most IDF of the document's rarest licence words agrees: (weight, start).

    Hits are (template, start, template position), sorted; a run of one (template, start) sums the weights of the distinct
    words at it. The state holds one place per template, so a long text with many hits costs a sort and one pass.
    """
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, _) in enumerate(templates):
        for p, word in enumerate(notice.split()):
            postings.setdefault(word, []).append((t, p))
    posting = lambda word, t, p: F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(idf[word] / templates[t][1].split().count(word)).alias("x"))
    index = F.create_map(*[c for word, at in sorted(postings.items()) for c in (F.lit(word), F.array(*[posting(word, t, p) for t, p in at]))])
    none = F.array().cast("array<struct<t:int,p:int,x:double>>")
    weights = F.create_map(*[c for word in sorted(postings) for c in (F.lit(word), F.lit(idf[word]))])
    held = F.array_intersect(F.col("w"), _strings(sorted(postings)))
    rarest = F.slice(F.array_sort(F.transform(held, lambda w: F.struct((-F.element_at(weights, w)).alias("k"), w.alias("w")))), 1, file_words)
    hit = lambda h, i: F.struct(h["t"].alias("t"), (i - h["p"]).alias("start"), h["p"].alias("p"), h["x"].alias("x"))
    looked_up = lambda own: F.transform("w", lambda w, i: F.transform(F.coalesce(F.element_at(own, w), none), lambda h: hit(h, i)))
    zero = F.struct(F.lit(0.0).alias("weight"), F.lit(None).cast("int").alias("start"))
    state = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("start"), F.lit(0.0).alias("weight"), F.array(*[zero] * len(templates)).alias("best"))

    def step(s: Column, h: Column) -> Column:
        same = (s["t"] == h["t"]) & (s["start"] == h["start"])
        weight = F.when(same, s["weight"] + h["x"]).otherwise(h["x"])
        better = F.element_at(s["best"], h["t"] + 1)["weight"] < weight
        renewed = F.transform(s["best"], lambda b, i: F.when(i == h["t"], F.struct(weight.alias("weight"), h["start"].alias("start"))).otherwise(b))
        return F.struct(h["t"].alias("t"), h["start"].alias("start"), weight.alias("weight"), F.when(better, renewed).otherwise(s["best"]).alias("best"))

    places = lambda own: F.aggregate(F.array_sort(F.flatten(looked_up(own))), state, step, lambda s: s["best"])
    own_index = lambda mine: F.map_filter(index, lambda word, _: F.array_contains(mine, word))
    return _once(F.transform(rarest, lambda r: r["w"]), lambda mine: _once(own_index(mine), places))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
