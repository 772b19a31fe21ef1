import corpus_pipeline
from tilespark.llm import queries
from tilespark.llm.util import written

from ..oracle import compare, tables

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts, tables_ = docs.columns, [docs.count()], [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables_.append(written(stage(spark, tables_[-1], SF)).table)
        counts.append(tables_[-1].count())
    for t in tables_[1:-1]:
        assert t.columns == names
    assert counts[1] == counts[0]  # all texts have letters of a known language
    assert counts[2] == tables_[1].select("text").distinct().count()
    from tilespark.llm.ngram_jaccard import JaccardJoin

    groups = JaccardJoin(tables_[2]).documents()
    assert counts[3] == groups.select("component_id").distinct().count()
    assert tables_[3].join(groups.where("doc_id = component_id"), "doc_id", "left_anti").isEmpty()
    assert 0 < tables_[4].count() and counts[5] > 0
    pieces = tables_[5]
    assert pieces.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").isEmpty()


def test_hard_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "", 0), (1, "", "en", "", 0), (2, "the same words as ever here", "en", None, 0), (3, "the same words as ever here", "en", "s", 0), (4, "x " * 50_000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for t in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            t = written(stage(spark, t, SF)).table
            t.count()


def test_sql(spark):
    con = tables(SF)
    for name, sql in queries.ORACLE_SQL.items():
        compare(spark, con, SF, queries.QUERIES[name], sql)


def test_all_eleven_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
