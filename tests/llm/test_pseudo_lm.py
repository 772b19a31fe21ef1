import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tilespark.llm import pseudo_lm as lm


def test_gradients():
    rng = np.random.default_rng(0)
    net = lm.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = rng.integers(1, 300, 60)
    bounds = np.array([0, 20, 20, 60])
    wide, place = lm.spread(ids, bounds)
    context, words = wide[place[::3, None] + lm.SHIFTS], ids[::3]
    g = net.gradients(context, words)
    whole = np.zeros_like(net.p["embed"])
    whole[g["embed"][0]] = g["embed"][1]
    g["embed"] = whole
    for k in lm.Network.SIZES:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in net.p[k].shape) if k != "embed" else (int(rng.choice(context.reshape(-1))), int(rng.integers(lm.WIDTH)))
            old = net.p[k][at]
            losses = []
            for d in (1e-4, -1e-4):
                net.p[k][at] = old + d
                losses.append(-net.log_probabilities(net.hidden(context), words).mean())
            net.p[k][at] = old
            assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(g[k][at], abs=1e-5)


def test_probabilities_sum_to_one():
    net = lm.Network(1)
    context = np.tile(np.array([[1, 2, 3, 4, 5, 6]]), (lm.CLASSES * lm.CLASS_WORDS, 1))
    assert np.exp(net.log_probabilities(net.hidden(context), np.arange(1, len(context) + 1))).sum() == pytest.approx(1, abs=1e-4)


def test_contexts_stay_in_their_text():
    wide, place = lm.spread(np.array([1, 2, 3, 4, 5]), np.array([0, 2, 2, 5]))
    found = wide[place[:, None] + lm.SHIFTS]
    assert found.tolist() == [[0, 0, 0, 2, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 0, 4, 5, 0], [0, 0, 3, 5, 0, 0], [0, 3, 4, 0, 0, 0]]
    net = lm.Network(2)
    assert np.allclose(net.running(wide)[place - lm.SIDE], net.hidden(found), atol=1e-6)


def test_slices_are_encoded_like_copies():
    import pyarrow as pa

    texts = [f" Ünder  WORD{k % 7} the\tEnd\n" * (k % 5) for k in range(3000)]
    words = lm.Words(["the", "end", "word3", "Ünder"])
    for lo in (0, 17, 2950):
        ids, bounds = words.encode(pa.array(texts).slice(lo, 50))
        each = [words.encode(pa.array([t]))[0].tolist() for t in texts[lo : lo + 50]]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == each
    assert words.encode(pa.array(["the END ünder Ünder"]))[0][[0, 1, 3]].tolist() == [65, 66, 68]


def test_training_tells_order_from_noise(spark):
    rng = np.random.default_rng(2)
    cycle = [f"w{k}" for k in range(12)]
    good = [" ".join(cycle[(s + k) % 12] for k in range(200)) for s in rng.integers(0, 12, 60)]
    noise = " ".join(rng.choice(cycle, 200))
    rows = [(i, t, "x") for i, t in enumerate(good)] + [(100, noise, "x"), (101, None, "x"), (102, " ", "x"), (None, "W1 w2\tw3", "x"), (3, good[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
    words = lm.vocabulary(docs)
    assert set(cycle) <= set(words)
    found = lm.score(docs, words, lm.train(docs, words, rounds=6)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[0].mean_log_likelihood > by[100].mean_log_likelihood + 0.5
    assert (by[101].n_tokens, by[101].log_likelihood, by[101].mean_log_likelihood) == (0, 0.0, None) == (by[102].n_tokens, by[102].log_likelihood, by[102].mean_log_likelihood)
    assert by[None].n_tokens == 3 and by[0].n_tokens == 200
    twice = [r.log_likelihood for r in found if r.doc_id == 3]
    assert twice[0] == pytest.approx(twice[1], abs=1e-2)


def test_empty_table(spark):
    assert lm.score_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_vocabulary_grows_with_the_distinct_words(spark):
    assert lm.vocabulary_size(0) == lm.vocabulary_size(400_000) == 4032
    assert lm.vocabulary_size(10**6) < lm.vocabulary_size(10**7) < lm.vocabulary_size(10**9)
    assert all(lm.side_of(lm.vocabulary_size(n)) ** 2 - lm.RARE == lm.vocabulary_size(n) for n in (0, 10**6, 10**7, 10**9))
    docs = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(5000)))], "doc_id long, text string")
    assert len(lm.vocabulary(docs)) == 4032
    words = lm.vocabulary(docs, most=5000)
    assert len(words) == 5000 and len(lm.score(docs, words, lm.train(docs, words)).collect()) == 1


def test_rare_words_have_shares_of_their_id(spark):
    pools = {}
    for k in range(2000):
        pools.setdefault(zlib.crc32(b"w%d" % k) % lm.RARE, []).append(f"w{k}")
    a, b, c = next(iter(pools.values()))[:3]
    texts = [a, b, c, f"{a.upper()} {a}\t{b}", None, "", f" {a} {b} {a} "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    by = {r.doc_id: r for r in lm.score(docs, [], lm.Network(1)).collect()}
    assert by[0].log_likelihood - by[1].log_likelihood == pytest.approx(np.log(5 / 3), abs=1e-4)
    assert sum(np.exp(by[k].log_likelihood) for k in range(3)) == pytest.approx(np.exp(by[0].log_likelihood) * 9 / 5, rel=1e-3)
    assert by[3].log_likelihood == pytest.approx(by[6].log_likelihood, abs=1e-4) and by[4].mean_log_likelihood is None


def test_words_beyond_the_vocabulary_meet_their_counts_in_packets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(0, 40)) % 3000) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    net, known, tables = lm.Network(1), ["w1", "w2"], []
    monkeypatch.setattr(lm, "SLICE_BYTES", 4000)
    monkeypatch.setattr(lm, "written", lambda df, f=lm.written: tables.append(f(df)) or tables[-1])
    ids = [[known.index(w) + 1 + lm.RARE if w in known else 1 + zlib.crc32(w.encode()) % lm.RARE for w in t.split()] for t in texts]
    n = Counter(w for t in texts for w in t.split())
    totals = Counter(i for t in ids for i in t)
    for most in (1 << 22, 4):  # a packet for each id, and many
        monkeypatch.setattr(lm, "GROUP_WORDS", most, raising=False)
        by = {r.doc_id: r for r in lm.score(docs, known, net).collect()}
        assert len(by) == len(texts)
        for k, (t, own) in enumerate(zip(texts, ids)):
            wide, place = lm.spread(np.array(own, int), np.array([0, len(own)]))
            each = net.log_probabilities(net.hidden(wide[place[:, None] + lm.SHIFTS]), np.array(own)) if own else np.zeros(0)
            shares = [np.log(n[w] / totals[i]) for w, i in zip(t.split(), own) if i <= lm.RARE]
            assert by[k].n_tokens == len(own) and by[k].log_likelihood == pytest.approx(each.sum() + sum(shares), abs=2e-3)
        if most > 4:
            slices = sum(map(len, texts)) // 2000 + 2
            assert tables[-1].table.count() <= slices * (lm.RARE + 1) < sum(len(set(t.split())) for t in texts)


def test_words_and_hashes_equal_plain_python():
    import pyarrow as pa

    texts = pa.array(["dropped", "", None, " \t", "a\x0bB\x0cc\x1cD É ß", "x" * 20000 + " " + "y" * 300, *[f"W{k}  v{k}\r\n" for k in range(200)], "last", "dropped"]).slice(1, 206)
    words, bounds = lm.words_of(texts)
    plain = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts.to_pylist()]
    assert [words.slice(a, b - a).to_pylist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())] == plain
    which = np.arange(0, len(words), 3)
    assert lm.hashes_of(words, which).tolist() == [zlib.crc32(words[int(k)].as_py()) for k in which]
    sizes = [lm.LONG + k % 3 - 1 for k in range(210)]
    long = pa.array([b"%03d" % k + b"x" * (n - 3) for k, n in enumerate(sizes)], pa.large_binary())
    assert lm.hashes_of(long, np.arange(210)).tolist() == [zlib.crc32(x.as_py()) for x in long]
    n = np.array([0, 1, 255, 256, 2**31 - 1])
    assert lm.numbers(lm.planes(n)).tolist() == n.tolist()
