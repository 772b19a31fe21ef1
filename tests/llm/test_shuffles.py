"""What the text operators move and keep."""

import pyarrow as pa

from tilespark.llm import ngram_jaccard, util


def exchanged(plan):
    """The columns of each exchange below a node of a physical plan."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.initialPlan()
    own = [plan.output().mkString(",")] if plan.nodeName() == "Exchange" else []
    return own + [x for k in range(plan.children().size()) for x in exchanged(plan.children().apply(k))]


def test_texts_of_pairs_are_shuffled_twice(spark):
    rows = [(i, f"the same words as ever here and so on {i % 3}") for i in range(6)]
    join = ngram_jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    keys = sorted(r.key for r in join.classes.select("key").collect())
    texts = join._with_texts(spark.createDataFrame([(keys[0], keys[1]), (keys[0], keys[2])], "a long, b long"))
    assert len({(r.a, r.b, r.text_a, r.text_b) for r in texts.collect()}) == 2
    assert all(r.text_a and r.text_b and r.text_a != r.text_b for r in texts.collect())
    assert sum("first#" in x or "max#" in x or "text#" in x for x in exchanged(texts._jdf.queryExecution().executedPlan())) == 2


def test_texts_of_many_pairs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SALT_PAIRS", 2)
    rows = [(None if i == 4 else i, f"some words of the document number {i}") for i in range(8)]
    join = ngram_jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    text = {r.key: r.text for r in join.classes.select("key", "rep.text_key").join(spark.createDataFrame(rows, "d long, text string").selectExpr("text", "xxhash64(text) AS text_key"), "text_key").collect()}
    keys = sorted(text)
    wanted = {(keys[0], k, text[keys[0]], text[k]) for k in keys[1:]}
    found = join._with_texts(spark.createDataFrame([(keys[0], k) for k in keys[1:]], "a long, b long"))
    assert {tuple(r) for r in found.collect()} == wanted


def test_memory_goes_back(monkeypatch):
    gone = []
    monkeypatch.setattr(util, "give_back", lambda: gone.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 30]})
    assert sum(x.num_rows for x in util.sliced(batch, 0, 12)) == 3 and gone == [1]


def test_members_of_long_lists_that_link_with_none_are_not_written_as_sets(spark, monkeypatch):
    """As in a corpus so large that counts tell no shingle from another: a common passage is in many prefixes."""
    sets, asked = ngram_jaccard._sets, []
    monkeypatch.setattr(ngram_jaccard, "LIST_PAIRS", 4)
    monkeypatch.setattr(ngram_jaccard, "_sets", lambda *a: (lambda rows, level: (rows, level * 0))(*sets(*a)))
    differences = ngram_jaccard.JaccardJoin._differences
    monkeypatch.setattr(ngram_jaccard.JaccardJoin, "_differences", lambda self, lists: asked.append(lists.select("key").distinct().count()) or differences(self, lists))
    passage = " ".join(f"p{k}" for k in range(40))
    own = lambda i: [f"w{i}x{k}" for k in range(160)]
    rows = [(i, " ".join([passage, *own(i)])) for i in range(40)]
    rows += [(100 + i, " ".join([passage, *own(i)[:-4]])) for i in range(6)] + [(200 + i, " ".join([passage, *own(90 + i // 2)[i % 2 :]])) for i in range(6)]
    join = ngram_jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r.component_id for r in join.documents().collect()}
    same = {100 + i: i for i in range(6)} | {200 + i: 200 + i // 2 * 2 for i in range(6)}
    assert found == {d: same.get(d, d) for d, _ in rows}
    assert sum(asked) <= 18  # the near copies at most, not the 34 that only share the passage
