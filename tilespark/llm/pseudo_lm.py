"""Language-model scoring by masked pseudo-likelihood.

A small network sees three words on either side of a place and predicts the word there: scaled embeddings are summed, a tanh
follows, and a softmax over word classes, then over the words of a class, gives the word's probability. Every document
gives its words: counts over the whole corpus make the vocabulary, and each partition trains on all its documents, with one
word in ten masked; partitions' networks are averaged by their masked words, and the next round starts from the average.
A document's score is the sum of the log-probabilities of all its words, each predicted from both sides.

The vocabulary grows with the corpus: about ``6.25 sqrt(distinct words)`` words, 4032 at least. Words beyond it share ids by
hash; the network predicts the id, and the word's share of its id's count, summed in groups of words, is its probability there.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checkpointed, sliced, tree_sum, written

#: Least number of classes and of words in each; both grow with the vocabulary.
CLASSES = 64
CLASS_WORDS = 64
GROWTH = 2.5
RARE = 64  # ids of words beyond the vocabulary, by hash
SIDE = 3
SHIFTS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
WIDTH = 32
MASKED = 0.1
ROUNDS = 2
BATCH = 4096
GATHERED = 16
RATE = 0.1
BLOCKS = 16
SLICE_BYTES = 4 << 20
PLACES = 1 << 13
GROUP_WORDS = 1 << 22  # most words of the corpus for a bucket of hashes, on average
LONG = 1 << 14  # bytes of a word that are hashed along with other words

SPACES = b"\t\n\v\f\r "
IN_WORD = bytes(k not in SPACES for k in range(256))
LOWER = bytes(range(256)).lower()
CRC = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)


def side_of(words: int) -> int:
    """Classes, and words in a class, that hold so many words and the rare ids."""
    return max(CLASSES, math.isqrt(words + RARE - 1) + 1)


def vocabulary_size(distinct: int) -> int:
    """Words of the vocabulary of a corpus of so many distinct ones."""
    return max(CLASSES, math.ceil(GROWTH * distinct**0.25)) ** 2 - RARE


class Network:
    """Parameters by name; ids 1 to ``side * side`` are words, 0 is what lies beyond a text's ends."""

    SIZES = ("embed", "scale", "bias", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, seed: int = 1, side: int = CLASSES):
        rng = np.random.default_rng(seed)
        self.side = side
        self.sizes = {"embed": (side * side + 1, WIDTH), "scale": (2 * SIDE, WIDTH), "bias": (WIDTH,), "class_w": (side, WIDTH), "class_b": (side,), "word_w": (side, side, WIDTH), "word_b": (side, side)}
        self.p = {k: (rng.normal(0, 0.1, s) if k in ("embed", "class_w", "word_w") else np.ones(s) if k == "scale" else np.zeros(s)).astype(np.float32) for k, s in self.sizes.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in self.SIZES])

    @classmethod
    def of(cls, flat: np.ndarray, side: int = CLASSES) -> Network:
        out, at = cls(side=side), 0
        for k, s in out.sizes.items():
            n = int(np.prod(s))
            out.p[k], at = flat[at : at + n].reshape(s).astype(np.float32), at + n
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = np.repeat(self.p["bias"][None], len(context), 0)
        for k in range(2 * SIDE):
            total += self.p["embed"][context[:, k]] * self.p["scale"][k]
        return np.tanh(total)

    def running(self, wide: np.ndarray) -> np.ndarray:
        """``hidden`` at every place of ``wide`` but the first and last ``SIDE``: one look-up a word, then shifted sums."""
        embedded, n = self.p["embed"][wide], len(wide) - 2 * SIDE
        total = np.repeat(self.p["bias"][None], n, 0)
        part = np.empty_like(total)
        for k, shift in enumerate(SHIFTS):
            total += np.multiply(embedded[SIDE + shift : SIDE + shift + n], self.p["scale"][k], out=part)
        return np.tanh(total, out=total)

    def scorer(self) -> _Scorer:
        return _Scorer(self)

    def log_probabilities(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of each word, from the hidden values at its place."""
        return self.scorer()(h, words)

    def gradients(self, context: np.ndarray, words: np.ndarray) -> dict:
        """Of the mean log-probability's negative. Those of ``embed`` are (ids, rows)."""
        p, n = self.p, len(words)
        kind, inner = np.divmod(words - 1, self.side)
        order = np.argsort(kind.astype(np.int16), kind="stable")
        context, kind, inner = context[order], kind[order], inner[order]
        bounds = np.searchsorted(kind, np.arange(self.side + 1)).tolist()
        h = self.hidden(context)
        soft = _softmax(h @ p["class_w"].T + p["class_b"])
        soft[np.arange(n), kind] -= 1
        g = {"class_w": soft.T @ h / n, "class_b": soft.mean(0), "word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
        back = soft @ p["class_w"]
        for c, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if lo == hi:
                continue
            part = _softmax(h[lo:hi] @ p["word_w"][c].T + p["word_b"][c])
            part[np.arange(hi - lo), inner[lo:hi]] -= 1
            g["word_w"][c], g["word_b"][c] = part.T @ h[lo:hi] / n, part.sum(0) / n
            back[lo:hi] += part @ p["word_w"][c]
        back *= (1 - h * h) / n
        g["bias"] = back.sum(0)
        g["scale"] = np.stack([(back * p["embed"][context[:, k]]).sum(0) for k in range(2 * SIDE)])
        flat = context.T.reshape(-1)
        each = (back[None] * p["scale"][:, None]).reshape(-1, WIDTH)
        by = np.argsort(flat.astype(np.int32), kind="stable")
        ids, first = np.unique(flat[by], return_index=True)
        g["embed"] = (ids, np.add.reduceat(each[by], first, axis=0))
        return g


class _Scorer:
    """Log-probabilities by a fixed network. Biases are a further column of the weights, against a constant hidden value of 1."""

    def __init__(self, network: Network):
        p, side = network.p, network.side
        self.side = side
        self.class_w = np.ascontiguousarray(np.concatenate([p["class_w"], p["class_b"][:, None]], 1).T)
        self.word_w = np.ascontiguousarray(np.concatenate([p["word_w"], p["word_b"][:, :, None]], 2).transpose(0, 2, 1))
        # Hidden values are between -1 and 1, so logits are within these sums; where they are small, exponents can't overflow.
        self.class_safe = np.abs(self.class_w).sum(0).max() < 80
        self.word_safe = np.abs(self.word_w).sum(1).max(1) < 80

    def __call__(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        kind, inner = np.divmod(words - 1, self.side)
        order = np.argsort(kind.astype(np.int16), kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(self.side + 1)).tolist()
        wide = np.empty((len(h), h.shape[1] + 1), np.float32)
        np.take(h, order, 0, out=wide[:, :-1])
        wide[:, -1] = 1
        found, inner = _log_softmax(wide @ self.class_w, kind[order], self.class_safe), inner[order]
        for c, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if lo < hi:
                found[lo:hi] += _log_softmax(wide[lo:hi] @ self.word_w[c], inner[lo:hi], self.word_safe[c])
        out = np.empty_like(found)
        out[order] = found
        return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def _log_softmax(logits: np.ndarray, at: np.ndarray, safe: bool = False) -> np.ndarray:
    if not safe:
        logits -= logits.max(1, keepdims=True)
    own = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], np.float32))


class Trainer:
    """Adagrad over mini-batches."""

    def __init__(self, network: Network, rate: float = RATE):
        self.network, self.rate = network, rate
        self.seen = {k: np.full(s, 1e-4, np.float32) for k, s in network.sizes.items()}

    def step(self, context: np.ndarray, words: np.ndarray) -> None:
        for k, v in self.network.gradients(context, words).items():
            rows = slice(None)
            if k == "embed":
                rows, v = v
            self.seen[k][rows] += v * v
            self.network.p[k][rows] -= self.rate * v / np.sqrt(self.seen[k][rows])


def spread(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``SIDE`` zeros before, between and after the texts, and where each id has come to lie."""
    place = np.arange(len(ids)) + np.repeat(SIDE * np.arange(1, len(bounds)), np.diff(bounds))
    wide = np.zeros(len(ids) + SIDE * len(bounds), ids.dtype)
    wide[place] = ids
    return wide, place


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, ASCII letters lower-cased, and where each text's begin (one more entry than texts)."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b""
    offsets = offsets - offsets[0]
    inside = np.frombuffer(data.translate(IN_WORD), bool)
    edge = np.zeros(len(data) + 1, bool)  # places where a text begins or ends
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    begin = np.flatnonzero(begin)
    upto = np.concatenate([[0], np.cumsum(np.flatnonzero(end) + 1 - begin)])
    kept = data.translate(LOWER, SPACES)
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(upto), pa.py_buffer(kept)]), np.searchsorted(begin, offsets)


def hashes_of(words: pa.Array, which: np.ndarray) -> np.ndarray:
    """CRC-32 of some of the words, a byte of all of them at a time; the last bytes of the few longest each on their own."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = offsets[which + 1] - offsets[which]
    order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int16), kind="stable")
    size, at = size[order], offsets[which[order]]
    crc, upto, left = np.full(len(which), 0xFFFFFFFF, np.uint32), 0, len(which)
    while (left := int(np.searchsorted(-size[:left], -upto))) > 64 and upto < LONG:
        now = crc[:left]
        crc[:left] = CRC[(now ^ data[at[:left] + upto]) & 255] ^ (now >> 8)
        upto += 1
    crc = crc ^ np.uint32(0xFFFFFFFF)
    for k in range(left):
        crc[k] = zlib.crc32(data[at[k] + upto : at[k] + size[k]], int(crc[k]))
    out = np.empty(len(which), np.int64)
    out[order] = crc
    return out


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` of all words of all texts, distributed."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 0):
                coded = words_of(batch.column(0))[0].dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_pydict({"word": coded.dictionary.cast(pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64())})

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return written(texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))).table


def vocabulary(docs: DataFrame, text_col: str = "text", most: int | None = None, counts: DataFrame | None = None) -> list[str]:
    """The words that occur most in all texts, by count, then by word; as many as ``vocabulary_size`` says if ``most`` is not given."""
    counts = counted(docs, text_col) if counts is None else counts
    most = vocabulary_size(counts.count()) if most is None else most

    def first(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for f in frames:
            best = pd.concat([best, f]).sort_values(["n", "word"], ascending=[False, True]).head(most)
        if best is not None:
            yield best

    # Each partition's first words, gathered in a few, so that what reaches the driver doesn't grow with the partitions.
    counts = counts.mapInPandas(first, "word string, n long").repartition(GATHERED)
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


class Words:
    """Texts to ids."""

    def __init__(self, words: list[str]):
        self.known = pa.array([w.encode() for w in words], pa.large_binary())

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its id; then which words are beyond the vocabulary, and their hashes."""
        ids = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy() + np.int32(1 + RARE)
        beyond = np.flatnonzero(ids == RARE)
        hashes = hashes_of(words, beyond)
        ids[beyond] = 1 + hashes % RARE
        return ids, beyond, hashes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of all texts, and where each text's begin (one more entry than texts)."""
        words, bounds = words_of(texts)
        return self.ids(words)[0], bounds

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """As ``encode``; then which of the distinct words beyond the vocabulary each word is, or -1; these words, and their hashes."""
        words, bounds = words_of(texts)
        coded = words.dictionary_encode()
        ids, beyond, hashes = self.ids(coded.dictionary)
        which = np.full(len(ids), -1, np.int32)
        which[beyond] = np.arange(len(beyond))
        codes = coded.indices.to_numpy()
        return ids[codes], bounds, which[codes], coded.dictionary.take(pa.array(beyond)), hashes


def planes(values: np.ndarray, kind: type = np.int32) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: small numbers are packed well by any compression."""
    return values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def numbers(packed: bytes, kind: type = np.int32) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def packets(bounds: np.ndarray, which: np.ndarray, rare: pa.Array, hashes: np.ndarray, buckets: int) -> tuple[list[tuple], tuple[bytes, bytes, bytes]]:
    """The distinct words beyond the vocabulary by bucket of their hash, with how often each occurs; and, for these words in
    that order, the number of texts that hold it, those texts, and how often each does."""
    texts, bucket = max(1, len(bounds) - 1), hashes % buckets
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(rare), np.int64)
    rank[order] = np.arange(len(rare))
    row, held = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), which >= 0
    each, times = np.unique(rank[which[held]] * texts + row[held], return_counts=True)
    word, row = np.divmod(each, texts)
    n = np.bincount(word, times, len(rare)).astype(np.int64)
    rare = rare.take(pa.array(order)).to_pylist()
    found, first = np.unique(bucket[order], return_index=True)
    spans = zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(rare)])
    return [(b, b" ".join(rare[lo:hi]), planes(n[lo:hi]), int(n[lo:hi].sum())) for b, lo, hi in spans], (planes(np.bincount(word, minlength=len(rare))), planes(row), planes(times))


def corpus_counts(table: pa.Table) -> pa.Table:
    """Of all packets of a bucket, how often each of their words occurs in all of them."""
    words, bounds = words_of(table.column("words").combine_chunks())
    codes = words.dictionary_encode().indices.to_numpy()
    times = np.concatenate([numbers(x) for x in table.column("times").to_pylist()])
    n = np.bincount(codes, times)[codes]
    counts = [planes(n[a:b], np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "counts": pa.array(counts, pa.binary())})


def train(docs: DataFrame, words: list[str], text_col: str = "text", rounds: int = ROUNDS, seed: int = 1) -> Network:
    """Rounds of training on every partition from the common network, averaged by masked words. No text: the first network."""
    side = side_of(len(words))
    network = Network(seed, side)
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("part"))

    for r in range(rounds):
        start = network.flat()

        def fit(batches: Iterable[pa.RecordBatch], start=start, r=r) -> Iterator[pd.DataFrame]:
            encoder, trainer, done, part, rng = Words(words), Trainer(Network.of(start, side)), 0, None, None
            for whole in batches:
                for batch in sliced(whole, 0, SLICE_BYTES):
                    if part is None:
                        part = batch.column(1)[0].as_py()
                        rng = np.random.default_rng([seed, r, part])
                    ids, bounds = encoder.encode(batch.column(0))
                    wide, places = spread(ids, bounds)
                    places = places[rng.random(len(ids)) < MASKED]
                    rng.shuffle(places)
                    for lo in range(0, len(places), BATCH):
                        some = places[lo : lo + BATCH]
                        trainer.step(wide[some[:, None] + SHIFTS], wide[some])
                    done += len(places)
            if done:
                values = np.array_split(trainer.network.flat().astype(np.float64) * done, BLOCKS)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part] * BLOCKS, pa.int64()), "chunk": pa.array(range(BLOCKS), pa.int64()),
                     "packed": pa.array([np.concatenate([[done], v]).astype(np.float32).tobytes() for v in values], pa.binary())}
                )

        parts = checkpointed(rows.mapInArrow(fit, "part long, chunk long, packed binary"))
        sums = {x["chunk"]: np.frombuffer(x["packed"], np.float32).astype(np.float64) for x in tree_sum(parts, _add).collect()}  # the network's size
        if not sums:
            break
        network = Network.of(np.concatenate([sums[k][1:] / sums[k][0] for k in range(BLOCKS)]), side)
    return network


def _add(packed: list[bytes]) -> bytes:
    return sum(np.frombuffer(x, np.float32).astype(np.float64) for x in packed).astype(np.float32).tobytes()


def score(docs: DataFrame, words: list[str], network: Network, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """Per input row: ``doc_id, n_tokens, log_likelihood, mean_log_likelihood``, over all words of the whole text.

    A word beyond the vocabulary has its id's probability times its share of the id's count; ``counts`` are those of ``docs``.
    Such words meet their counts in packets, of a slice's words in a bucket of their hash; only counts come back to the slice.
    Null, empty and wordless texts have no tokens, a sum of 0 and a null mean. Equal texts score alike up to rounding to
    six places; repeated rows stay; an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("part"))
    flat, side = network.flat(), network.side
    all_words = (counted(docs, text_col) if counts is None else counts).agg(F.sum("n")).first()[0] or 0
    buckets = RARE * max(1, math.ceil(all_words / (RARE * GROUP_WORDS)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, net, slices = Words(words), Network.of(flat, side), 0
        scorer = net.scorer()
        for whole in batches:
            for batch in sliced(whole, 1, SLICE_BYTES):
                ids, bounds, which, rare, hashes = encoder.coded(batch.column(1))
                wide, place = spread(ids, bounds)
                each = np.zeros(len(wide))
                for lo in range(SIDE, len(wide) - SIDE, PLACES):
                    part = wide[lo - SIDE : lo + PLACES + SIDE]
                    each[lo : lo + PLACES][: len(part) - 2 * SIDE] = scorer(net.running(part), np.maximum(part[SIDE : len(part) - SIDE], 1))
                each = each[place]
                n = np.diff(bounds)
                total = np.array([each[a:b].sum() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
                at = (batch.column(2)[0].as_py() << 32) + slices
                slices += 1
                packed, held = packets(bounds, which, rare, hashes, buckets)
                k = len(packed)
                bucket, joined, times, sums = zip(*packed) if packed else [()] * 4
                lists = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "total": pa.array(total, pa.float64())}
                yield pa.RecordBatch.from_pydict(
                    {"slice": pa.array([at] * (k + 1), pa.int64()), "bucket": pa.array([*bucket, None], pa.int64()), "words": pa.array([*joined, None], pa.binary()), "times": pa.array([*times, None], pa.binary()), "n": pa.array([*sums, None], pa.int64()),
                     **{c: pa.concat_arrays([pa.nulls(k, pa.list_(x.type)), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)]) for c, x in lists.items()},
                     **{c: pa.array([None] * k + [x], pa.binary()) for c, x in zip(("texts", "text", "often"), held)}}
                )

    both = written(rows.mapInArrow(run, "slice long, bucket long, words binary, times binary, n long, doc_id array<long>, n_tokens array<long>, total array<double>, texts binary, text binary, often binary")).table
    sums = dict(both.where("bucket is not null").groupBy((F.col("bucket") % RARE).alias("id")).agg(F.sum("n")).collect())  # at most RARE rows
    logs = np.log([sums.get(k, 1) for k in range(RARE)])

    def shares(own: pa.Table, back: pa.Table) -> pa.Table:
        """A slice's texts, their sums with those over their rare words."""
        own, back = {c: own.column(c)[0] for c in own.column_names}, back.sort_by("bucket")
        total, bucket = own["total"].values.to_numpy(), back.column("bucket").to_numpy()
        if len(bucket):
            n = [numbers(x, np.int64) for x in back.column("counts").to_pylist()]
            share = np.log(np.concatenate(n)) - np.repeat(logs[bucket % RARE], [len(x) for x in n])
            texts, text, often = (numbers(own[c].as_py()) for c in ("texts", "text", "often"))
            total = total + np.bincount(text, np.repeat(share, texts) * often, len(total))
        return pa.table({"doc_id": own["doc_id"].values, "n_tokens": own["n_tokens"].values, "total": pa.array(total)})

    back = both.where("bucket is not null").select("slice", "bucket", "words", "times").groupBy("bucket").applyInArrow(corpus_counts, "slice long, bucket long, counts binary")
    own = both.where("bucket is null").select("slice", "doc_id", "n_tokens", "total", "texts", "text", "often")
    scored = own.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(shares, "doc_id long, n_tokens long, total double")
    return scored.select(
        "doc_id", "n_tokens", F.round("total", 6).alias("log_likelihood"), F.when(F.col("n_tokens") > 0, F.round(F.col("total") / F.col("n_tokens"), 6)).alias("mean_log_likelihood")
    )


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    counts = counted(docs, text_col)
    words = vocabulary(docs, text_col, counts=counts)
    return score(docs, words, train(docs, words, text_col), id_col, text_col, counts)
