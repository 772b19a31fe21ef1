import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tilespark.llm import mixing


def sainte_lague(votes, house):
    seats = [0] * len(votes)
    for _ in range(house):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
        seats[k] += 1
    return seats


@pytest.mark.parametrize("seed", range(4))
def test_highest_quotients(spark, seed):
    rng = random.Random(seed)
    votes = [rng.choice([0.0, rng.random() * 10, rng.random() * 1000]) for _ in range(rng.choice([1, 5, 30]))] + [3.0]
    house = rng.choice([0, 7, round(sum(votes))])
    parties = spark.createDataFrame([(1, k, v, house, None) for k, v in enumerate(votes)], "g int, k int, votes double, house long, most_seats long")
    found = {r.k: r.seats for r in mixing.highest_quotients(parties, ["g"], ["k"]).collect()}
    assert [found[k] for k in range(len(votes))] == sainte_lague(votes, house)
    limits = [max(1, round(v * rng.choice([0.9, 1.0, 1.2]))) for v in votes]
    house = min(house, sum(limits)) if house else 0
    limited = spark.createDataFrame([(1, k, v, house, m) for k, (v, m) in enumerate(zip(votes, limits))], "g int, k int, votes double, house long, most_seats long")
    for seats in (mixing.highest_quotients(limited, ["g"], ["k"]), mixing.quotients_in_groups(limited, ["g"], "k", size=4)):
        won = {r.k: r.seats for r in seats.collect()}
        assert all(won[k] <= m for k, m in enumerate(limits))
        assert sum(won.values()) <= house
    assert {r.k: r.seats for r in mixing.quotients_in_groups(parties, ["g"], "k").collect()} == found


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(names, [3.0, 1.0, 2.0] * len(names)))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{k}" for k in range(rng.choice([0, 1, 5, 50, 400]))) or rng.choice([None, "", " \n"]), rng.choice(["hot"] * 8 + ["a", "b", "é", "", None, "tiny"]), 0) for i in range(600)]
    return rows + [(3, "same twice", "a", 0)] * 2 + [(None, "no id", "tiny", 0), (9999, "one word more", "single", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_taken_words_come_near_targets(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(4)
    found = mixing.mix_plan(docs, shard_rows=100).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    assert len(found) == len(rows)
    expected = targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(2, 0.03 * t), (s, taken[s], t)
    again = mixing.mix_plan(docs.repartition(2), shard_rows=100).collect()
    assert sorted(repr((r.doc_id, r.size, r.taken)) for r in again) == sorted(repr((r.doc_id, r.size, r.taken)) for r in found)


def test_many_sources_and_a_long_text(spark):
    rows = [(i, "word " * (1 + i % 9), f"host{i % 3000}") for i in range(6000)] + [(9999, "long " * 300_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_plan(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    expected, taken = targets(sizes), defaultdict(int)
    for r in found:
        assert r.target == pytest.approx(expected[r.source])
        taken[r.source] += r.taken
    assert len(found) == len(rows)
    assert all(abs(taken[s] - t) <= max(2, 0.03 * t) for s, t in expected.items())


def test_mixed_texts_have_the_words_taken(spark):
    docs = spark.createDataFrame(rows_of(5), "doc_id long, text string, source string, n_chars int")
    planned = {(r.doc_id, r.source): r.n for r in mixing.mix_plan(docs, shard_rows=100).groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).collect() if r.n}
    mixed = mixing.mix(docs, shard_rows=100)
    assert mixed.columns == docs.columns
    words = F.regexp_count("text", F.lit(mixing.WORD))
    assert {(r.doc_id, r.source): r.n for r in mixed.groupBy("doc_id", "source").agg(F.sum(words).alias("n")).collect()} == planned
    assert mixed.where("n_chars <> length(text)").isEmpty()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(docs).collect() == [] and mixing.mix(docs).collect() == []
