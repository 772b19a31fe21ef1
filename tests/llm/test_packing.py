import struct
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tilespark.llm import packing

WHOLE = Tokenizer.from_file(packing.tokenizer_path())

MESSY = [
    "The quick brown fox", "", None, "  lead and trail \n", "tab\tvt\x0bff\x0cfs\x1cgs\x1dnbsp\xa0em nel\x85end", "It's we'll 'S ΣΑΣ Σ",
    "a<|endoftext|>b <|startoftext|> c", "é e ́x", "日本語 テキスト 123 4567", "x" * 3000, " line par", "İstanbul ǅ ﬁ", "\x00zero \x1f unit", "İs 'S don'T ?'s ŉa ½x2³ Ǆ ħ", "H\u0331 E\u0301 e\u0301, É! ÀÉ-ß ſ K", "<|ENDOFTEXT|> a<|x <|endoftext|", "\u00ad\u00a1soft\u00ad",
]


def test_ids_equal_the_tokenizer_on_whole_texts():
    texts = [t or "" for t in MESSY]
    found = packing.WordTokens(packing.tokenizer_path()).encode(pa.array(texts), 2)
    for t, ids in zip(texts, found):
        assert ids.tolist() == WHOLE.encode(t, add_special_tokens=False).ids + [2], t


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("aAéÉßİǄſ'sStTlL.,!? 9½³<|>~\u0301\u0331\u00a0\u0085\x1c\tΣσΩ日"), max_size=30))
def test_ids_of_odd_texts(text):
    ids = packing.WordTokens.of(packing.tokenizer_path()).encode(pa.array(["first", text, "last"]), 2)[1]
    assert ids.tolist() == WHOLE.encode(text, add_special_tokens=False).ids + [2]


def test_ids_of_contractions():
    texts = ["it's 's ''s ?'s 'sx 'rex 'll'd they'RE 'v 'l 'r don't'", "'", "s'", "x'9's", "À'S'É", "a1b22 3'd4", "¿Qué? «œuvre» Œ ß ÿ 5°"]
    for t, ids in zip(texts, packing.WordTokens.of(packing.tokenizer_path()).encode(pa.array(texts), 2)):
        assert ids.tolist() == WHOLE.encode(t, add_special_tokens=False).ids + [2], t


def test_slices_are_encoded_like_copies():
    texts = [t or "" for t in MESSY] * 40
    words = packing.WordTokens.of(packing.tokenizer_path())
    whole = words.encode(pa.array(texts), 2)
    for lo in (1, 300):
        assert [x.tolist() for x in words.encode(pa.array(texts).slice(lo, 90), 2)] == [x.tolist() for x in whole[lo : lo + 90]]


def test_ids_of_documents():
    import duckdb

    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    for t, ids in zip(texts, packing.WordTokens.of(packing.tokenizer_path()).encode(pa.array(texts), 2)):
        assert ids.tolist() == WHOLE.encode(t, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("parts", [1, 5])
def test_pieces_cover_each_document_once(spark, parts):
    texts = MESSY + ["word " * k for k in (1, 5, 60, 61, 62, 130, 400)] * 3
    rows = [(i if i % 7 else i - i % 7, t, i) for i, t in enumerate(texts)] + [(None, "no id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(parts)
    found = packing.pack_documents(docs, window=64, open_windows=3, merge_partitions=2).collect()
    whole = Tokenizer.from_file(packing.tokenizer_path())
    expected = sorted((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for _, t, _ in rows for ids in [whole.encode(t or "", add_special_tokens=False).ids + [2]])
    sequences, by_doc = defaultdict(list), defaultdict(int)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 64
    assert sum(by_doc.values()) == sum(n for n, _ in expected)
    short = [r for r in found if r.length == r.doc_tokens]
    assert {(r.length, r.ids_crc32) for r in short} <= set(expected)
    part = sum(64 - sum(n for _, n in p) for p in sequences.values()) / (64 * len(sequences))
    assert part < 0.2


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_cut_pieces_have_their_own_ids(spark):
    rows = [(1, "word and other words, " * 500), (2, "short"), (3, None), (4, "number 12 " * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    whole = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    at = dict.fromkeys(whole, 0)
    for r in sorted(packing.pack_documents(docs, window=64).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at[r.doc_id] += r.length
    assert at == {d: len(ids) for d, ids in whole.items()}


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises((ValueError, IndexError)):
        packing.WordTokens(packing.tokenizer_path("byte_bpe_50k.json"))
