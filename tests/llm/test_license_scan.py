import math
import random
import re

import pytest

from tilespark.llm import license_scan

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", "  -- ", "MIT License", "mit\nlicense, MIT-License; mitlicense", "cc-by 4.0", "accby bycc cc by", "The GNU General  Public License and GNU general public license.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Licensed under CC BY-NC 4.0.",
    "All rights reserved.", "apache license", "Ünder the MIT License İ", "mit " * 500 + "license", "license " * 3000 + "released under the mit license " * 50,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "public domain general license version",
]


def brute(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    at = sorted(i for i, _ in places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def brute_labels(text, idf, file_words):
    """Labels and score from the definition: every place of every template is tried, on the document's rarest licence words."""
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    mine = set(sorted(set(words) & set(idf), key=lambda w: (-idf[w], w))[:file_words])
    labels, score = set(filter(None, brute(text)[4].split(","))), 0.5 if brute(text)[1] else 0.0
    for label, notice, phrases in license_scan.TEMPLATES:
        own = notice.split()
        best = 0.0
        for start in range(-len(own), len(words)):
            best = max(best, sum(idf[w] / own.count(w) for p, w in enumerate(own) if w in mine and 0 <= start + p < len(words) and words[start + p] == w))
        share = min(1.0, best / sum(idf[w] for w in set(own)))
        if share >= license_scan.LEAST_SHARE and all(f" {p} " in " " + " ".join(words) + " " for p in phrases):
            labels.add(label)
            score = max(score, share)
    return ",".join(sorted(labels)), score


@pytest.mark.parametrize("file_words", [32, 5])
def test_labels_and_score_equal_brute_force(spark, file_words):
    rng = random.Random(file_words)
    texts = [t for t in TEXTS if len(t or "") < 3000]
    licence_words = license_scan.vocabulary()
    for _, notice, phrases in license_scan.TEMPLATES:
        words = notice.split()
        for _ in range(4):
            some = [w if rng.random() > 0.15 else rng.choice(licence_words) for w in words]
            texts.append(" ".join(rng.choices(licence_words, k=rng.randrange(6)) + some + rng.choices(phrases, k=rng.randrange(2)) + ["end"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = license_scan.word_idf(docs)
    for r in license_scan.scan_licenses(docs, idf=idf, file_words=file_words).collect():
        labels, score = brute_labels(texts[r.doc_id], idf, file_words)
        assert r.labels == labels and abs(r.score - score) < 1e-5, texts[r.doc_id]
    held = [set(WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t in texts]
    for w, x in idf.items():
        assert abs(x - math.log((len(texts) + 1) / (sum(w in h for h in held) + 1)) - 1e-6) < 1e-9


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, w string")
    return {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}


def test_base_equals_brute_force(spark):
    found = scan(spark, TEXTS)
    assert len(found) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
        if r.labels == "":
            assert r.score == 0


def test_templates_are_found_where_they_stand(spark):
    notices = [f"word {k} before. {notice.title()}; after it" for k, (_, notice, _) in enumerate(license_scan.TEMPLATES)]
    found = scan(spark, notices + TEXTS)
    for k, (label, _, _) in enumerate(license_scan.TEMPLATES):
        assert label in found[k].labels.split(","), label
        assert {m.label: m.start for m in found[k].matches}[label] == 3
        assert found[k].score == 1
    clean = len(notices) + TEXTS.index("public domain general license version")
    assert found[clean].labels == ""


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan_licenses(docs).collect() == []
