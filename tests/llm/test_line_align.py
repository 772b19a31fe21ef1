import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tilespark.llm import line_align

lines = st.lists(st.integers(0, 6), max_size=14)


@settings(max_examples=300, deadline=None)
@given(lines, lines)
def test_patience_aligns_equal_items_in_order(a, b):
    found = line_align.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
    assert line_align.patience(a, a) == [(i, i) for i in range(len(a))]
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(found) <= best[-1][-1] and bool(found) == bool(best[-1][-1])


def brute_force(rows, least):
    """Every later document against the first document that has one of its lines."""
    docs = sorted({(d is None, d or 0, t or ""): (d, t or "") for d, t in rows}.items())
    seen, out = {}, {}
    split = lambda t: [x.strip(" ") or None for x in t.split("\n")]
    for _, (d, t) in docs:
        mine, gone = split(t), set()
        for o in {seen[x] for x in mine if x in seen}:
            gone |= set(line_align.repeated_lines(mine, [len((x or "").split()) for x in mine], split(o), least))
        for x in mine:
            if x is not None:
                seen.setdefault(x, t)
        out[d, t] = sorted(gone)
    return out


def test_removed_lines_equal_brute_force(spark):
    rng = random.Random(1)
    pool = [" ".join(f"p{k}x{m}" for m in range(rng.choice([2, 6, 12]))) for k in range(40)]
    passage = pool[:6]
    rows = []
    for i in range(120):
        body = [f"own line {i} {k} of a text" for k in range(rng.randrange(6))] + rng.sample(pool, rng.randrange(4))
        rng.shuffle(body)
        at = rng.randrange(len(body) + 1)
        rows.append((i, "\n".join(body[:at] + (passage if rng.random() < 0.3 else []) + ["", "  "][: rng.randrange(3)] + body[at:])))
    rows += [(200, None), (201, ""), (None, rows[4][1]), (300, rows[5][1]), rows[7], (301, "\n\n")]
    docs = spark.createDataFrame([(d, t, i, 0) for i, (d, t) in enumerate(rows)], "doc_id long, text string, key int, n_chars long")
    expected = brute_force(rows, 10)
    found = line_align.find_repeated_lines(docs, least_words=10).collect()
    assert len(found) == len(expected)
    by_id = {}
    for (d, _), gone in expected.items():
        by_id.setdefault(d, []).append(gone)
    for r in found:
        assert list(r.removed) in by_id[r.doc_id], r.doc_id
    texts = line_align.drop_repeated_lines(docs, least_words=10)
    assert texts.columns == docs.columns
    want = sorted((repr(d), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in expected[d, t])) if t else (repr(d), t) for d, t in rows)
    got = sorted(((repr(r.doc_id), r.text) for r in texts.collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert texts.where("n_chars <> length(text)").where("text is not null").isEmpty()


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(1, "Yes.\nall of this is new"), (2, "Yes.\nand this one too")], "doc_id long, text string")
    assert sorted(map(tuple, line_align.drop_repeated_lines(docs).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_align.find_repeated_lines(docs).collect() == [] and line_align.drop_repeated_lines(docs).collect() == []


def in_earlier(rows, least):
    """Every line of every stretch of lines, of enough words, that an earlier document has as it is."""
    out, before = [], []
    for d, t in rows:
        at = [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
        mine, gone = [x for _, x in at], set()
        for lo in range(len(mine)):
            for hi in range(lo + 1, len(mine) + 1):
                part = mine[lo:hi]
                if sum(len(x.split()) for x in part) >= least and any(part == o[k : k + len(part)] for o in before for k in range(len(o))):
                    gone |= {k for k, _ in at[lo:hi]}
        out.append((d, sorted(gone)))
        before.append(mine)
    return out


def test_blocks_of_any_order_and_number_go():
    rng = random.Random(4)
    for _ in range(400):
        size = [rng.choice([1, 3, 4, 12]) for _ in range(6)]
        old, new = ([rng.choice([None, *range(6)]) for _ in range(rng.randrange(14))] for _ in range(2))
        text = lambda d: "\n".join("" if x is None else " ".join([f"w{x}"] * size[x]) for x in d)
        want = in_earlier([(0, text(old)), (1, text(new))], 10)[1][1]
        assert line_align.repeated_lines(new, [0 if x is None else size[x] for x in new], old, 10) == want
    assert line_align.repeated_lines([1, 2, 3], [9, 5, 11], [3, 7, 1, 2]) == [0, 1, 2]
    assert line_align.repeated_lines([5, 1, 6, 1], [1, 12, 1, 12], [7, 1, 8]) == [1, 3]


def test_swapped_doubled_and_unowned_passages_go(spark):
    rng = random.Random(5)
    pool = [" ".join(f"q{k}x{m}" for m in range(rng.choice([1, 4, 6, 9, 12]))) for k in range(12)]
    rows = []
    for i in range(60):
        body = [rng.choice(pool) if rng.random() < 0.7 else f"own {i} {k}" for k in range(rng.randrange(9))]
        rows.append((i, "\n".join(x + ["", " ", "\n"][rng.randrange(3)] for x in body)))
    # Both lines have earlier owners, neither of which holds them together.
    rows += [(70, "alone a b c d e f"), (71, "other g h i j"), (72, "alone a b c d e f\nother g h i j"), (73, "x\nalone a b c d e f\n\nother g h i j\ny")]
    found = line_align.find_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, list(r.removed)) for r in found) == in_earlier(rows, 10)
    assert dict(in_earlier(rows, 10))[73] == [1, 3]
