import random
import re

import numpy as np
import pytest

from tilespark.llm import ngram_jaccard
from tilespark.llm.components import connected_components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted((repr((d, len(s), least[root(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))))


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [w, f"new{rng.randrange(10**6)}"] if x < 2 * rate / 3 else [f"alt{rng.randrange(10**6)}"] if x < rate else [w]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 80, 200]))] for _ in range(40)]
    texts = [None, "", "  \n ", "One", "one", "a b c d", "A B  C\td", "a b c d e"]
    for b in bases:
        texts.append(" ".join(b))
        texts += [" ".join(edited(rng, b, rng.choice([0.0, 0.005, 0.01, 0.02, 0.05]))) for _ in range(rng.choice([0, 1, 3, 12]))]
    texts += [" ".join(rng.choices(vocabulary, k=rng.choice([5, 20])) + passage) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += rows[:3] + [(None, rows[5][1]), (None, "no id but words enough to have shingles")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, key int").repartition(3)
    found = ngram_jaccard.JaccardJoin(docs).documents().collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in found) == brute_force(rows)


def test_hot_group_makes_few_pairs(spark):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 0.004, 0.01, 0.03])))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = ngram_jaccard.JaccardJoin(docs)
    assert sorted(repr(tuple(r)) for r in join.documents().collect()) == brute_force(rows)
    assert join.links.count() < 4000


def test_near_but_unlike_group_makes_pairs_in_proportion(spark, monkeypatch):
    """Documents around one base, most of them unlike each other: candidates must not grow with the square of the group."""
    made = []
    verified = ngram_jaccard.JaccardJoin._verified
    monkeypatch.setattr(ngram_jaccard.JaccardJoin, "_verified", lambda self, pairs: made.append(pairs.count()) or verified(self, pairs))
    rng = random.Random(600)
    base = [f"b{k}" for k in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.035))) for i in range(600)]
    join = ngram_jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(repr(tuple(r)) for r in join.documents().collect()) == brute_force(rows)
    assert sum(made) < 10 * len(rows)  # of 179,700 pairs


def test_words_are_compared_not_hashes():
    word = [0]
    for _ in range(10):
        word += [1 - x for x in word]
    one, other = ("".join("ab"[x ^ k] for x in word).encode() for k in (0, 1))
    for cut in (ngram_jaccard.shingles, ngram_jaccard.exact_shingles):
        (x,), (y,) = cut([one])[:1], cut([other])[:1]
        assert len(x) == len(y) == 1
        a, b = cut([one, other])
        assert a.tolist() != b.tolist()
    text = "a b c d e f a b c d e X"
    rng = random.Random(5)
    texts = [text, text.upper(), "", "q", "Q", "a b", "b a"] + [" ".join(rng.choices("abc", k=rng.randrange(12))) for _ in range(200)]
    sets, exact, plain = (f([t.encode() for t in texts]) for f in (ngram_jaccard.shingles, ngram_jaccard.exact_shingles, lambda x: [shingle_set(t) for t in texts]))
    for s, e, p in zip(sets, exact, plain):
        assert len(s) == len(e) == len(p)
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(set(sets[i].tolist()) & set(sets[j].tolist())) == len(set(exact[i].tolist()) & set(exact[j].tolist())) == len(plain[i] & plain[j])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard.JaccardJoin(docs).documents().collect() == []


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}


def test_every_link_is_counted(spark):
    draw = np.random.default_rng(8)
    base = [f"t{k}" for k in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in draw.integers(0, 60, draw.integers(0, 3)):
            words[at] = f"n{draw.integers(0, 9)}"
        texts.append(" ".join(words))
    texts += [texts[0], None, " ", "few words", "Few  words", " ".join(base[:55])]
    sets = [set(s.tolist()) for s in ngram_jaccard.shingles([(t or "").encode() for t in texts])]
    want = [sum(j != i and bool(s) and len(s & z) * 100 >= 80 * len(s | z) for j, z in enumerate(sets)) for i, s in enumerate(sets)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    join = ngram_jaccard.JaccardJoin(docs)
    assert [n for _, n in sorted(map(tuple, join.link_counts().collect()))] == want
    postings = spark.createDataFrame([(1, k, 50, 0, 0) for k in range(30)], "token long, key long, n int, place int, shared int")
    join._suffix_filtered = lambda pairs: pairs
    assert join._all_pairs(postings, block=4).count() == 30 * 29 // 2 == join._all_pairs(postings).count()
