"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition streams its documents: whole windows are cut off long ones, and what remains goes best-fit into one of at
most ``open_windows`` open windows; when none fits, the fullest is emitted and a new one opened. Windows still open at the
end, at most ``open_windows`` a partition, carry their ids; groups of ``merge_partitions`` partitions lay theirs end to end
and cut them at the window's edge, so that only the last window of a group has padding.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checkpointed, sliced

WINDOW = 4096
OPEN_WINDOWS = 64
MERGE_PARTITIONS = 16
END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CACHED_WORDS = 1 << 19
#: What a tokenizer must cut as ``WordTokens`` does.
PROBES = ["Plain Words it's 12-3, x_y (a.b)!", "ünï 日本語 İx \u00a0 <b>&amp;", "  ", "a\tb\nC\x0bd", "\u200bzero e\u0301 ½²"]
SLICE_BYTES = 1 << 20

def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids of whole texts through a cache of their words.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its words between ASCII white
    space, laid end to end. Plain texts (``plain_parts``) are cut further, as the tokenizer itself cuts them, in one pass
    over all bytes. Each distinct word of a slice is looked up once; a full cache is emptied between slices.
    """

    kept: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """One for each worker process, so that its tasks share the cache."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[k for name, k in names.items() if name.endswith("</w>")]] = True
        self.forget()
        for text, ids in zip(PROBES, self.encode(pa.array(PROBES), END_ID)):
            if ids[:-1].tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"{path} does not lower-case and cut texts as this operator does")

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.used = 0
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, words: list[str], parts: bool) -> None:
        """Ids of new words. Words that are one part each end in an id that ends a word, so many are encoded as one text."""
        for lo in range(0, len(words), 20_000):
            some = words[lo : lo + 20_000]
            if parts:
                ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
                edges = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
                if len(edges) != len(some) + 1:
                    raise ValueError("a part is not one word to the tokenizer")
            else:
                found = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                edges = np.cumsum([0, *map(len, found)])
                ids = np.fromiter((k for x in found for k in x), np.uint32, edges[-1])
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.place.update(zip(some, range(len(self.place), len(self.place) + len(some))))
            self.starts = np.concatenate([self.starts, self.used + edges[:-1]])
            self.sizes = np.concatenate([self.sizes, np.diff(edges)])
            self.used += len(ids)

    def _encoded(self, coded: pa.DictionaryArray, bounds: np.ndarray, end_id: int, parts: bool) -> list[np.ndarray]:
        distinct = coded.dictionary.cast(pa.large_string()).to_pylist()
        if len(self.place) + len(distinct) > CACHED_WORDS:
            self.forget()
        self.learn([w for w in distinct if w not in self.place], parts)
        rows = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        codes = coded.indices.to_numpy()
        rows = rows[codes] if len(codes) else np.empty(0, np.int64)
        lengths = self.sizes[rows]
        before = np.concatenate([[0], np.cumsum(lengths)])
        source = np.repeat(self.starts[rows] - before[:-1], lengths) + np.arange(before[-1])
        begins = before[bounds] + np.arange(len(bounds))
        out = np.full(begins[-1], end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[begins[1:] - 1] = False
        out[inside] = self.ids[source]
        return [out[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]

    def encode(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text, ``end_id`` after them."""
        plain, parts, bounds = plain_parts(texts)
        out: list = [None] * len(texts)
        for k, ids in zip(np.flatnonzero(plain).tolist(), self._encoded(parts.dictionary_encode(), bounds, end_id, True)):
            out[k] = ids
        if not plain.all():
            split = pc.ascii_split_whitespace(texts.filter(pa.array(~plain)).cast(pa.large_string()))
            bounds = split.offsets.to_numpy().astype(np.int64)
            words = split.values.slice(bounds[0], bounds[-1] - bounds[0])
            for k, ids in zip(np.flatnonzero(~plain).tolist(), self._encoded(words.dictionary_encode(), bounds - bounds[0], end_id, False)):
                out[k] = ids
        return out


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each ASCII byte and of each pair of bytes: 0 white space, 1 letter, 2 digit, 3 other, 9 not plain."""
    one = np.full(256, 9, np.uint8)
    one[[9, 10, 11, 12, 13, 32]] = 0
    one[33:127] = 3
    one[48:58] = 2
    one[65:91] = one[97:123] = 1
    two = np.full(1 << 16, 9, np.uint8)
    for code in (*range(0xC0, 0x100), 0x152, 0x153):
        if code not in (0xD7, 0xF7):
            two[int.from_bytes(chr(code).encode(), "big")] = 1
    for code in (0xA1, 0xA7, 0xAB, 0xB0, 0xB7, 0xBB, 0xBF):
        two[int.from_bytes(chr(code).encode(), "big")] = 3
    return one, two


#: By rule: ASCII but controls; Latin-1 letters and the oe ligature; some Latin-1 signs. None of these is changed by
#: normalising, has combining marks, or is white space to the tokenizer.
ONE, TWO = _classes()
_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[65:91] += 32


def plain_parts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which texts are plain; the lower-cased parts of these, as the tokenizer cuts them; and where each text's begin.

    Parts are runs of letters, single digits, runs of other signs, and English contractions where an apostrophe begins a run.
    """
    raw = [b for b in texts.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer(b" ".join([*raw, b""]) + b"    ", np.uint8)
    ends = np.cumsum([len(b) + 1 for b in raw])
    kind = ONE[data]
    high = np.flatnonzero(data >= 0x80)
    lead = high[data[high] >= 0xC0]
    pair = TWO[data[lead].astype(np.int32) << 8 | data[lead + 1]]
    kind[lead] = kind[lead + 1] = pair
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # the start of a control string
    bad = np.concatenate([np.flatnonzero(kind == 9), special])
    plain = np.ones(len(raw), bool)
    plain[np.searchsorted(ends, bad, "right")] = False
    for k in np.flatnonzero(~plain).tolist():
        kind[ends[k] - len(raw[k]) - 1 : ends[k]] = 0
    low = _DOWN[data]
    latin = lead[(data[lead] == 0xC3) & (data[lead + 1] < 0x9F)]
    low[latin + 1] += 0x20
    low[lead[(data[lead] == 0xC5) & (data[lead + 1] == 0x92)] + 1] += 1
    before = np.concatenate([[0], kind[:-1]])
    start = (kind != 0) & ((kind != before) | (kind == 2))
    start[lead + 1] = False
    quote = np.flatnonzero((low == 39) & start)
    a, b = low[quote + 1], low[quote + 2]
    short = quote[(a == 115) | (a == 116) | (a == 109) | (a == 100)]  # 's 't 'm 'd
    long = quote[((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))]  # 're 've 'll
    start[short + 1] = start[long + 1] = False
    start[short + 2] |= kind[short + 2] == 1
    start[long + 3] |= kind[long + 3] == 1
    at = np.flatnonzero(start)
    kept = kind != 0
    offsets = np.concatenate([(np.cumsum(kept, dtype=np.int32) - kept)[at], [np.count_nonzero(kept)]]).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(low[kept].tobytes())])
    bounds = np.searchsorted(at, ends)[plain]
    return plain, parts, np.concatenate([[0], bounds])


class OpenWindows:
    """At most ``most`` windows that are neither full nor emitted, by their free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}
        self.next = 0

    def put(self, piece: tuple, length: int) -> list[list]:
        """Place a piece; return the windows that leave, as lists of their pieces."""
        out = []
        k = bisect_left(self.free, (length, -1))
        if k < len(self.free):
            free, window = self.free.pop(k)
        else:
            if len(self.free) >= self.most:
                out.append(self.pieces.pop(self.free.pop(0)[1]))
            free, window = self.size, self.next
            self.next += 1
            self.pieces[window] = []
        self.pieces[window].append(piece)
        if free == length:
            out.append(self.pieces.pop(window))
        else:
            insort(self.free, (free - length, window))
        return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)


class _Rows:
    """Output rows gathered into batches."""

    FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "merge_group", "ids")

    def __init__(self):
        self.rows: list[tuple] = []

    def window(self, pieces: list, sequence: int | None, group: int | None = None) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids)
            left = sequence is None
            self.rows.append((doc_id, start, n, 0 if left else _crc(ids), doc_tokens, sequence, offset, group, ids.tobytes() if left else None))
            offset += n

    def take(self, least: int = 1) -> Iterator[pd.DataFrame]:
        if len(self.rows) >= least:
            done, self.rows = self.rows, []
            frame = pd.DataFrame(done, columns=self.FIELDS)
            for c in ("doc_id", "sequence_id", "merge_group"):
                frame[c] = frame[c].astype("Int64")
            yield frame


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, merge_partitions: int = MERGE_PARTITIONS,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the ids of its whole text and ``end_id``; null counts as empty, so it is ``end_id`` alone. Each id is in
    one piece; pieces lie in their sequence without gaps from offset 0. Repeated rows and null ids are packed like others.
    An empty table gives an empty result; other columns are not looked at. ``path`` is a tokenizer file that lower-cases and
    cuts at white space and punctuation as the default one does; another kind is refused.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, windows, out = WordTokens.of(path), OpenWindows(window, open_windows), _Rows()
        part, emitted = 0, 0

        def emit(pieces: list) -> None:
            nonlocal emitted
            out.window(pieces, (part << 32) + emitted)
            emitted += 1

        for whole in batches:
            for batch in sliced(whole, 1, SLICE_BYTES):
                part = batch.column(2)[0].as_py()
                for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1), end_id)):
                    n = len(ids)
                    edge = n - n % window
                    for at in range(0, edge, window):
                        emit([(doc_id, at, ids[at : at + window], n)])
                    if edge < n:
                        for full in windows.put((doc_id, edge, ids[edge:].copy(), n), n - edge):
                            emit(full)
                yield from _batches(out.take(5_000))
        for pieces in windows.pieces.values():
            out.window(pieces, None, part // merge_partitions)
        yield from _batches(out.take())

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = _Rows()
        base, n, pieces, room = (1 << 60) + (int(key[0]) << 32), 0, [], window
        for row in frame.sort_values(["part", "order"]).itertuples():
            ids = np.frombuffer(row.ids, np.uint32)
            at = 0
            while at < len(ids):
                take = min(room, len(ids) - at)
                pieces.append((None if pd.isna(row.doc_id) else int(row.doc_id), int(row.start) + at, ids[at : at + take], int(row.doc_tokens)))
                at, room = at + take, room - take
                if not room:
                    out.window(pieces, base + n)
                    n, pieces, room = n + 1, [], window
        if pieces:
            out.window(pieces, base + n)
        found = list(out.take())[0]
        return found[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    packed = checkpointed(
        rows.mapInArrow(pack, f"{PIECES}, merge_group long, ids binary").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("order"))
    )
    done = packed.where("ids is null").drop("merge_group", "ids", "part", "order")
    left = packed.where("ids is not null").groupBy("merge_group").applyInPandas(merge, PIECES)
    return done.unionByName(left)


def _batches(frames: Iterable[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    types = {"ids": pa.binary()}
    for frame in frames:
        yield pa.RecordBatch.from_pandas(frame, pa.schema([(c, types.get(c, pa.int64())) for c in frame.columns]), preserve_index=False)
