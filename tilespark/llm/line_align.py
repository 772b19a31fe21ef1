"""Line deduplication by pairwise alignment.

A run is a stretch of consecutive non-blank lines that just reaches the least number of words, counted from its first line on
or from its last line back. Every run that several documents hold names the earliest of them its owner, so the documents that
share a run make a star and not all pairs; every line of any block of enough words that an earlier document holds is in a run
of that block. Each later document is aligned with each of its owners by patience diff: lines that occur once in both anchor
the alignment along their longest increasing run, and what lies between anchors is aligned in turn. Where that leaves lines
which the owner has too, swapped or repeated ones, they are aligned with the whole owner, each by the longest block that ends
there. Aligned blocks of enough words go from the later one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .util import WORD, checkpointed

LEAST_WORDS = 10


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal items, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        in_a, in_b = Counter(a[i:ie]), Counter(b[j:je])
        place = {x: k for k, x in enumerate(b[j:je], j) if in_b[x] == 1}
        both = [(k, place[x]) for k, x in enumerate(a[i:ie], i) if in_a[x] == 1 and x in place]
        anchors = _increasing(both)
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (ie, je)]):
            if anchors and (r > p + 1 and s > q + 1):
                todo.append((p + 1, r, q + 1, s))
        out += anchors
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs``, sorted by the first, that increases in the second."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _blocks(a: list[int], b: list[int]) -> list[int]:
    """For every place of ``a`` the length of the longest block that ends there and lies anywhere in ``b``: a suffix automaton of ``b``."""
    length, link, step = [0], [-1], [{}]
    last = 0
    for x in b:
        new, p = len(length), last
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[q] > length[p] + 1:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    out, at, n = [], 0, 0
    for x in a:
        while at and x not in step[at]:
            at = link[at]
            n = length[at]
        if x in step[at]:
            at, n = step[at][x], n + 1
        out.append(n)
    return out


def repeated_lines(later: list[int | None], words: list[int], owner: list[int | None], least_words: int = LEAST_WORDS) -> list[int]:
    """Lines of ``later`` in blocks that ``owner`` has too, without a gap in either but for blank lines, of ``least_words`` at least."""
    mine = [k for k, x in enumerate(later) if x is not None]
    theirs = [x for x in owner if x is not None]
    lines = [later[k] for k in mine]
    upto = [0]
    for k in mine:
        upto.append(upto[-1] + words[k])
    gone: set[int] = set()
    start, last = 0, (-2, -2)
    for i, j in [*patience(lines, theirs), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if last[0] >= 0 and upto[last[0] + 1] - upto[start] >= least_words:
                gone.update(range(start, last[0] + 1))
            start = i
        last = (i, j)
    there = set(theirs)
    if any(x in there and i not in gone for i, x in enumerate(lines)):
        low = len(lines)
        for i, n in reversed(list(enumerate(_blocks(lines, theirs)))):
            if n and upto[i + 1] - upto[i + 1 - n] >= least_words:
                gone.update(range(i + 1 - n, min(i + 1, low)))
                low = min(low, i + 1 - n)
    return [mine[i] for i in sorted(gone)]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs(lines: np.ndarray, words: np.ndarray, least_words: int = LEAST_WORDS) -> np.ndarray:
    """Hashes of the shortest runs of ``least_words`` from every line on and from every line back; equal runs have equal hashes."""
    n = len(lines)
    if not n:
        return np.empty(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(words)])
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + least_words, "left"), np.arange(n) + 1)
    starts = np.minimum(np.searchsorted(upto, upto[1:] - least_words, "right") - 1, np.arange(n))
    on, back = ends <= n, starts >= 0
    lo, hi = np.concatenate([np.flatnonzero(on), starts[back]]), np.concatenate([ends[on], np.flatnonzero(back) + 1])
    with np.errstate(over="ignore"):
        # A prefix sum of line hashes times powers, divided by the power of the first place, so that only the run itself counts.
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]), dtype=np.uint64)
        unpower = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _UNBASE)]), dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(lines.astype(np.int64).view(np.uint64)) * power[:n], dtype=np.uint64)])
        return np.unique(_mixed((total[hi] - total[lo]) * unpower[lo] + (hi - lo).astype(np.uint64)).view(np.int64))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def find_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``key, doc_id, n_lines, removed``: per document the places, from 0, of the lines that go.

    Lines are equal when they are after trimming spaces; blank ones match nothing. Documents are ordered by id, null last,
    then by a hash of id and text. Rows that repeat both id and text are one document. Null texts have one blank line. An empty
    table gives an empty result; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.transform(_lines(F.col("text")), lambda x: F.trim(x))
    table = checkpointed(
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        .select("doc_id", document_key("doc_id", "text").alias("key"), lines.alias("lines"))
        .select(
            "key", "doc_id",
            F.transform("lines", lambda x: F.when(x != "", F.xxhash64(x))).alias("hashes"),
            F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD)).cast("int")).alias("words"),
        )
        .dropDuplicates(["key"])
    )

    def run_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lines, words in zip(batch.column(1), batch.column(2)):
                lines, words = lines.values, words.values
                real = pc.is_valid(lines)
                found.append(runs(lines.filter(real).to_numpy(zero_copy_only=False), words.filter(real).to_numpy(zero_copy_only=False), least_words))
            ends = np.cumsum([0, *map(len, found)])
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "doc_id": batch.column(3), "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))})

    with_runs = StructType([*table.select("key", "doc_id").schema.fields, StructField("runs", ArrayType(LongType()))])
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    each = table.select("key", "hashes", "words", "doc_id").mapInArrow(run_hashes, with_runs).select("key", order.alias("order"), F.explode("runs").alias("hash"))
    owners = each.groupBy("hash").agg(F.min("order").alias("owner"), F.count(F.lit(1)).alias("documents")).where("documents > 1").select("hash", F.col("owner.key").alias("owner"))
    pairs = each.join(owners, "hash").where("key != owner").select("key", "owner").distinct()
    later = table.select("key", F.col("hashes").alias("later"), "words")
    early = table.select(F.col("key").alias("owner"), F.col("hashes").alias("early"))
    both = pairs.join(later, "key").join(early, "owner").select("key", "later", "words", "early")

    def align(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(key, _integers(a), list(w), _integers(b)) for key, a, w, b in frame.itertuples(index=False)]
            found = [(key, gone) for key, a, w, b in rows if (gone := repeated_lines(a, w, b, least_words))]
            yield pd.DataFrame({"key": pd.Series([k for k, _ in found], dtype="int64"), "removed": pd.Series([g for _, g in found], dtype=object)})

    # Arrays with nulls would reach pandas as floats; a string keeps 64-bit hashes whole.
    text_of = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), " ")
    aligned = both.select("key", text_of("later").alias("later"), "words", text_of("early").alias("early")).mapInPandas(align, "key long, removed array<int>")
    removed = aligned.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))
    out = table.select("key", "doc_id", F.size("hashes").cast("long").alias("n_lines")).join(removed, "key", "left")
    return out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def _integers(joined: str) -> list[int | None]:
    return [None if x == "-" else int(x) for x in joined.split(" ")]


def document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(3), F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines; other columns and rows stay, and a text without such lines is untouched.

    ``n_chars``, if it is a column, follows the text. A text whose lines all go is empty; null texts and an empty table stay as
    they are. Columns named ``__own``, ``__key``, ``__removed`` or ``__text`` are the function's own and must not be in ``docs``.
    """
    found = find_repeated_lines(docs, id_col, text_col, least_words).where("size(removed) > 0")
    found = found.select(F.col("key").alias("__key"), F.col("removed").alias("__removed"))
    joined = docs.withColumn("__own", document_key(id_col, text_col)).join(found, F.col("__own") == F.col("__key"), "left")
    kept = F.array_join(F.filter(_lines(F.col(text_col)), lambda x, k: ~F.array_contains("__removed", k)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(kept)
    out = joined.withColumn("__text", text)
    return out.select(
        *[
            F.col("__text").alias(c) if c == text_col else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
            for c in docs.columns
        ]
    )
