import hashlib
from collections import defaultdict

import pytest

from tilespark.llm import exact_dedup


def rows_of(heavy):
    texts = ["a", "a", "b", "", None, "ü", "ü ", "x" * 50_000] + ["copied"] * heavy
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    return rows + [(None, "copied", 1), (None, "alone", 1), (2, "b", 1), (2, "b", 1)]


@pytest.mark.parametrize("support", [0.001, 0.2, 0.9])
@pytest.mark.parametrize("heavy", [0, 60])
def test_groups_equal_brute_force(spark, heavy, support):
    rows = rows_of(heavy)
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int").repartition(3)
    found = exact_dedup.exact_groups(docs, support=support).collect()
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[t or ""].append(d)
    expected = sorted((repr(d), repr(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in found) == expected
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_drop_keeps_one_row_of_each_text(spark):
    rows = rows_of(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n int")
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    texts = [r.text or "" for r in found]
    assert sorted(texts) == sorted({t or "" for _, t, _ in rows})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs).collect() == []
    assert exact_dedup.drop_exact_copies(docs).collect() == []
