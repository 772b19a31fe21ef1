import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tilespark.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 150
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)


def test_presence_is_of_each_text_alone():
    texts = [b"", b"abc", b"xyz\0", "é日".encode() * 9]
    alone = [langid.presence([t])[0] for t in texts]
    assert (langid.presence(texts) == alone).all()
    assert not alone[0].any()


def test_kernel_and_ridge_equal_their_definition():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcde " if k % 2 else "defgh ", k=rng.randrange(5, 60))).encode() for k in range(40)]
    grams = [{(n, (t + bytes(4))[i : i + n]) for n in langid.GRAMS for i in range(len(t))} for t in texts]  # one starts at every byte
    seen = langid.presence(texts, bits=20)  # of so many buckets that grams hardly meet
    x = langid.normalised(seen)
    for i in range(40):
        for j in range(40):
            want = len(grams[i] & grams[j]) / (len(grams[i]) * len(grams[j])) ** 0.5
            assert abs(float(x[i] @ x[j]) - want) < 0.02
    languages = ["odd" if k % 2 else "even" for k in range(40)]
    small = langid.presence(texts)
    model = langid.KernelRidge(small, languages, landmarks=40, ridge=1e-2)
    z = langid.normalised(small).astype(float)
    kernel = z @ z.T  # with every text a landmark, Nyström is plain kernel ridge regression
    y = np.array([[1.0 if a == b else -1.0 for b in model.languages] for a in languages])
    plain = kernel @ np.linalg.solve(kernel + 1e-2 * 40 * np.eye(40), y)
    assert np.abs(model.scores(texts) - plain).max() < 0.02


def test_signs_are_no_letters(spark):
    texts = ["½ ② Ⅷ ²", "٣٤ _ __", "a", "ª", "日"]
    rows = [(i, "plain words of a language", "en") for i in range(40)] + [(100 + k, t, None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()}
    assert [found[100 + k] != "und" for k in range(len(texts))] == [any(c.isalpha() for c in t) for t in texts]


def test_only_text_decides(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["der", "und", "ist", "nicht"] if i % 2 else ["the", "and", "is", "not"], k=20)), "de" if i % 2 else "en", "s") for i in range(60)]
    odd = [(100, None, "de", "s"), (101, "", "en", "s"), (102, "12 34 !?", "en", None), (None, "the and is", None, None), (103, "日本語" * 30, None, "s"), (5, rows[5][1], "en", "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    found = langid.identify(docs, model).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r.doc_id: r for r in found if r.doc_id != 5}
    assert [by[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and by[None].lang_pred == "en"
    assert len({(r.lang_pred, r.score) for r in found if r.doc_id == 5}) == 1
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {100, 101, 102} & set(ids) == set() and len(ids) >= len(rows) + 2


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "5", None)], "doc_id long, text string, lang string")
    assert langid.train(docs) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert [r.doc_id for r in langid.keep_known(docs).collect()] == [1]
    assert langid.identify(docs.where(F.lit(False)), None).collect() == []


def test_every_labelled_language_is_learned(spark):
    rows = [(i, " ".join(f"l{i % 205}x{k}" for k in range(4)), f"l{i % 205}") for i in range(205 * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert set(model.languages) == {f"l{k}" for k in range(205)}
    assert set(langid.train(docs, per_language=1).languages) == set(model.languages)
