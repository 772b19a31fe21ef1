"""Similarity join on word n-grams: rare-first prefix filtering, with length, positional and suffix filters.

A document is the set of its five-word shingles, by 64-bit hashes. Documents of equal sets form a class; only classes are
joined. All shingles have one global order, rarest first: by the logarithm of a count over all documents, kept in a table of
fixed size, then by hash. Two sets of Jaccard similarity ``t`` share one of their first ``n - ceil(t n) + 1`` shingles, so
classes meet on these. A posting knows its set's size (length filter), its place, and how many of the places before it are
shared with any class at all (positional filter). Counts of both sets in the same fixed parts of the hash space bound the
overlap of what remains (suffix filter). A pair that passes is verified once, on whole texts.

Links matter for what they connect, so no group's pairs are all made. First every posting list gives a star around its
member with the fewest shingles of its own, its hub, and a chain by size: a pair per posting. Then short lists give the pairs
between what are still different components. Of long lists, members go first that hold too many shingles alone to link with
any other, like most that only share a passage. Near but unlike ones that stay are told apart by how they differ from
the hub: ``x`` and ``y`` differ in as many shingles as their two symmetric differences from it do, so where not both are
linked to the hub, a link makes those differences overlap by about half at least. They are joined like the sets before, rarest
first by exact counts around the hub, and what only one member has takes its prefix up without meeting anyone. A link inside a
component adds nothing to it; all others are found. ``all_links`` makes and verifies every candidate pair of every list
instead, which grows with the square of a group, and ``link_counts`` counts them per document.

Shingles are hashes of their words' hashes while pairs are sought; a pair is verified on the words themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .util import WORD, checkpointed, release, sliced, tree_sum, written

WORDS = 5
SIMILARITY = (80, 100)
SKETCH_BITS = 20
CHUNK_BITS = 16
PARTS = 64
#: Bits of the bitmap of wanted texts: so many for each, within bounds.
BITS_EACH = 16
LEAST_BITMAP, MOST_BITMAP = 16, 26
LIST_BLOCK = 256
#: Longer lists are joined by differences from their hubs.
LIST_PAIRS = 64
#: A text of more pairs goes to several tasks.
SALT_PAIRS = 256
SLICE_BYTES = 1 << 20
#: What tells a row of the documents, and one of how many shingles is looked at where members of long lists are told apart.
ROW = ("text_key", "id", "no_id")
ONE_OF = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def split_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Which of the distinct lower-cased words each word of the texts (UTF-8) is, those words, and where each text's begin."""
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]) + b" ", np.uint8)]
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), bounds


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8). A text of fewer words has one shingle, of them all."""
    codes, distinct, bounds = split_words(texts)
    if not len(codes):
        return [np.empty(0, np.uint64)] * len(texts)
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[codes]
    n = max(0, len(word) - words + 1)
    run = np.full(n, words, np.uint64)
    for k in range(words):
        run = _next(run, word[k : k + n])
    run = _mixed(run)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(run[lo : hi - words + 1]))
        elif hi > lo:
            few = np.full(1, hi - lo, np.uint64)
            for k in range(lo, hi):
                few = _next(few, word[k : k + 1])
            out.append(_mixed(few))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _next(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    run = (run ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return run ^ (run >> np.uint64(32))


def exact_shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """As ``shingles``, but numbers that are equal, among these texts, only where all words are."""
    codes, _, bounds = split_words(texts)
    run = codes.astype(np.int64)
    for k in range(1, words):
        if len(run) > 1:
            # Runs of k words have numbers below len(codes), so these are below the square of a slice's words.
            run = np.unique(run[:-1] * len(codes) + codes[k : k + len(run) - 1], return_inverse=True)[1]
    short: dict[tuple, int] = {}
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(run[lo : hi - words + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(codes[lo:hi].tolist()), len(short))] if hi > lo else [], np.int64))
    return out


def needed(n: np.ndarray | int, similarity=SIMILARITY):
    """Least overlap of a set of ``n`` with any set that is similar to it."""
    a, b = similarity
    return -(-a * n // b)


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in sliced(batch, column, SLICE_BYTES):
        yield part, shingles([b or b"" for b in part.column(column).cast(pa.large_binary()).to_pylist()])


def _text_pairs(batches: Iterable[pa.RecordBatch], cut) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """Slices of rows ``a, b, text_a, text_b`` with the shingles of both texts."""
    for batch in batches:
        for part in sliced(batch, 2, SLICE_BYTES):
            texts = [b or b"" for column in (2, 3) for b in part.column(column).cast(pa.large_binary()).to_pylist()]
            sets = cut(texts)
            yield part, sets[: part.num_rows], sets[part.num_rows :]


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _scan(docs: DataFrame, id_col: str, text_col: str, more: list) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), *more)


def _sets(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """Rows ``doc_id, n, set_key`` (null for no words), and the table of shingle counts over all documents as log counts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for batch in batches:
            for rows, sets in _runs(batch, 1):
                part = rows.column(3)[0].as_py()
                table += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(table))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": rows.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "set_key": pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                     "part": pa.nulls(len(sets), pa.int64()), "chunk": pa.nulls(len(sets), pa.int64()), "counts": pa.nulls(len(sets), pa.binary())}
                )
        if table.any():
            chunks = table.reshape(-1, 1 << CHUNK_BITS)
            k = len(chunks)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.nulls(k, pa.int64()), "n": pa.nulls(k, pa.int64()), "set_key": pa.nulls(k, pa.binary()), "part": pa.array([part] * k, pa.int64()),
                 "chunk": pa.array(range(k), pa.int64()), "counts": pa.array([_pack(c) for c in chunks], pa.binary())}
            )

    scan = _scan(docs, id_col, text_col, [F.spark_partition_id().cast("long").alias("part")])
    found = checkpointed(scan.mapInArrow(count, "doc_id long, n long, set_key binary, part long, chunk long, counts binary"))
    sums = tree_sum(found.where("chunk is not null").select("part", "chunk", F.col("counts").alias("packed")), lambda each: _pack(sum(map(_unpack, each))))
    table = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in sums.collect():  # the table's fixed size
        table[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = _unpack(r["packed"])
    level = np.minimum(255, np.round(6 * np.log2(np.maximum(table, 1)))).astype(np.uint8)
    return found.where("n is not null").select("doc_id", "n", "set_key"), level


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(np.asarray(counts, np.int64).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int64)


def _classes(docs: DataFrame, id_col: str, text_col: str, level: np.ndarray, similarity) -> DataFrame:
    """A row per class: ``key, set_key, n, rep, least_id, least_text, prefix, parts``; ``rep`` is (doc_id, text_key) of one of its rows."""

    def prefix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in _runs(batch, 1):
                keep = [i for i, s in enumerate(sets) if len(s)]
                prefixes, parts = [], []
                for i in keep:
                    s = sets[i]
                    order = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                    p = len(s) - needed(len(s), similarity) + 1
                    order = np.partition(order, p - 1)[:p] if p < len(s) else order
                    prefixes.append(np.sort(order).view(np.int64))
                    parts.append(np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32))
                ends = np.cumsum([0, *map(len, prefixes)])
                picked = rows.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": picked.column(0), "text_key": picked.column(2), "set_key": pa.array([_set_key(sets[i]) for i in keep], pa.binary()), "n": pa.array([len(sets[i]) for i in keep], pa.int32()),
                     "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes) if keep else [], pa.int64())),
                     "parts": pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * PARTS, pa.int32()), pa.array(np.concatenate(parts) if keep else [], pa.int32()))}
                )

    rows = _scan(docs, id_col, text_col, []).mapInArrow(prefix, "doc_id long, text_key long, set_key binary, n int, prefix array<long>, parts array<int>")
    classes = rows.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))["text_key"].alias("least_text"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts")
    )
    return classes.withColumn("key", F.monotonically_increasing_id())


def _plain_id(doc_id: Column) -> tuple[Column, Column]:
    """An id without null, and whether it was null: for joins by plain equality."""
    return F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id")


def _rep() -> tuple[Column, ...]:
    """The columns ``ROW`` of a class's row."""
    return F.col("rep.text_key").alias("text_key"), *_plain_id(F.col("rep.doc_id"))


def _pairs(a, b):
    """Columns of a pair in order of key."""
    first = F.col(f"{a}key") < F.col(f"{b}key")
    return F.when(first, F.col(f"{a}key")).otherwise(F.col(f"{b}key")).alias("a"), F.when(first, F.col(f"{b}key")).otherwise(F.col(f"{a}key")).alias("b")


def _may_link(a: str, b: str, similarity, size: str = "n") -> Column:
    """Length and positional filter on two postings of one shingle.

    Before places i and j at most ``min(r, s)`` shingles are shared, r and s being how many of those before are shared with
    any class; after them, at most what the shorter rest has. ``size`` is that of the lists that places count in: of the sets
    themselves, or of their differences from one hub, whose overlap a link bounds in the same way.
    """
    p, q = similarity
    n, m, d, e, i, j, r, s = (F.col(x + c) for c in ("n", size, "place", "shared") for x in (a, b))
    length = (F.lit(p) * F.greatest(n, m)) <= (F.lit(q) * F.least(n, m))
    overlap = F.least(r, s) + F.least(d - i, e - j)
    return length & (F.lit(2 * (p + q)) * overlap >= F.lit(p + q) * (d + e) - F.lit(q - p) * (n + m))


class JaccardJoin:
    """``rows`` (doc_id, n, set_key), ``classes`` (key, set_key, n, rep) and ``links`` (a, b) between classes.

    ``links`` connects all that any links connect; inside a component that other links already connect, links are left out.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity=SIMILARITY):
        self.docs, self.id_col, self.text_col, self.similarity = docs, id_col, text_col, similarity
        self.rows, self.level = _sets(docs, id_col, text_col)
        whole = written(_classes(docs, id_col, text_col, self.level, similarity))
        release(docs.sparkSession)
        postings = written(self._postings(whole.table))
        slim = written(whole.table.drop("prefix"))
        whole.drop()
        self.classes, self.postings = slim.table, postings.table
        release(docs.sparkSession)
        first = checkpointed(self._near_pairs())
        release(docs.sparkSession)
        links = self._verified(first)
        release(docs.sparkSession)
        linked = connected_components(links)
        release(docs.sparkSession)
        more = checkpointed(self._more_pairs(linked).join(first, ["a", "b"], "left_anti"))
        postings.drop()
        release(docs.sparkSession)
        self.links = checkpointed(links.unionByName(self._verified(more)))
        release(docs.sparkSession)
        self.components = connected_components(self.links)

    def _postings(self, classes: DataFrame) -> DataFrame:
        """``token, key, n, place, shared, own``: prefix shingles that two classes have at least; ``own`` is how many of the class's no other has, in a thousand."""
        p, q = self.similarity
        each = classes.select("key", "n", F.posexplode("prefix").alias("place", "token"))
        by_token = Window.partitionBy("token").orderBy("n", "key")
        several = each.withColumn("other", F.coalesce(F.lag("key").over(by_token), F.lead("key").over(by_token))).where("other is not null").drop("other")
        in_class = Window.partitionBy("key").orderBy("place")
        held = F.count(F.lit(1)).over(Window.partitionBy("key"))
        prefix = F.expr(f"n - ({p} * n + {q - 1}) div {q} + 1")
        return several.withColumn("shared", F.row_number().over(in_class) - 1).withColumn("own", (F.lit(1000) * (prefix - held) / prefix).cast("int"))

    def _near_pairs(self) -> DataFrame:
        """Of each posting list a star around its hub and a chain by size, where the filters pass."""
        by_size = Window.partitionBy("token").orderBy("n", "key")
        whole_list = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        names = ("key", "n", "place", "shared")
        me = F.struct(*names)
        hub = F.min_by(me, F.struct("own", "key")).over(whole_list)
        met = self.postings.select(*names, F.array(hub, F.lag(me).over(by_size)).alias("others"))
        met = met.select(*[F.col(c).alias(f"x_{c}") for c in names], F.explode("others").alias("y")).where("y.key != x_key")
        met = met.select("*", *[F.col(f"y.{c}").alias(f"y_{c}") for c in names])
        return self._suffix_filtered(met.where(_may_link("x_", "y_", self.similarity)).select(*_pairs("x_", "y_")).distinct())

    def _more_pairs(self, components: DataFrame) -> DataFrame:
        """Pairs of different components: on short lists, with the hubs of long ones, and on lists of differences from these."""
        lists = self.postings.withColumns({"d": F.col("n"), "linked": F.lit(False)})
        mixed = written(self._mixed_lists(lists, components))
        long = F.col("members") > LIST_PAIRS
        pairs, kept = self._pairs_across(mixed.table.where(~long)), [mixed]
        if not mixed.table.where(long).isEmpty():
            left = written(self._mixed_lists(self._without_lone(mixed.table.where(long)).select(*lists.columns), components))
            release(self.docs.sparkSession)
            kept.append(left)
            pairs = pairs.unionByName(self._pairs_across(left.table.where(~long)))
            if not left.table.where(long).isEmpty():
                sets = written(self._differences(left.table.where(long)))
                release(self.docs.sparkSession)
                around = written(self._mixed_lists(self._difference_lists(sets.table), components))
                release(self.docs.sparkSession)
                kept += [sets, around]
                pairs = pairs.unionByName(sets.table.where("linked").select(*_pairs("hub_", ""))).unionByName(self._pairs_across(around.table))
            pairs = pairs.distinct()
        pairs = checkpointed(self._suffix_filtered(pairs))
        for w in kept:
            w.drop()
        return pairs

    def _mixed_lists(self, lists: DataFrame, components: DataFrame) -> DataFrame:
        """The lists of several components, with each class's ``component``, the list's largest, ``main``, and the number of ``members``."""
        lists = lists.join(components.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        sizes = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
        mixed = sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("members"), F.count(F.lit(1)).alias("components")).where("components > 1").drop("components")
        return lists.join(mixed, "token")

    def _pairs_across(self, lists: DataFrame) -> DataFrame:
        """Pairs of different components on one list, each with a member outside the list's largest component."""
        names = ("token", "key", "n", "d", "place", "shared", "linked", "component")
        left = lists.where("component != main").select("main", *[F.col(c).alias(f"x_{c}") for c in names])
        right = lists.select(*[F.col(c).alias(f"y_{c}") for c in names])
        once = (F.col("y_component") == F.col("main")) | (F.col("x_key") < F.col("y_key"))
        apart = (F.col("x_component") != F.col("y_component")) & ~(F.col("x_linked") & F.col("y_linked"))
        met = left.join(right, (F.col("x_token") == F.col("y_token")) & apart & once & _may_link("x_", "y_", self.similarity, "d"))
        return met.select(*_pairs("x_", "y_")).distinct()

    def _without_lone(self, lists: DataFrame) -> DataFrame:
        """``lists`` less the members of which so many shingles are held by no other member of any of them that they link with none.

        One of ``ONE_OF`` shingles by hash is looked at, the same of all members. A link leaves at most ``1 - t`` of a set's
        shingles to it alone. Without this, each member that only shares a passage with a hub would be written as two whole
        sets for each of its lists, and the more lists grow long, the more there are of these.
        """
        p, q = self.similarity
        members = checkpointed(lists.select("key").distinct().join(self.classes, "key").select("key", "n", *_rep()))

        def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, sets in _runs(batch, 1):
                    sets = [s[s % np.uint64(ONE_OF) == 0] for s in sets]
                    row = np.repeat(rows.column(0).to_numpy(), [len(s) for s in sets])
                    yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int64()), "shingle": pa.array(np.concatenate(sets).view(np.int64), pa.int64())})

        row = F.xxhash64(*ROW).alias("row")
        each = self._rows_about(members).select(row, "text").mapInArrow(some, "row long, shingle long")
        alone = each.groupBy("shingle").agg(F.min("row").alias("row"), F.max("row").alias("other")).where("row = other")
        lone = members.withColumn("row", row).join(alone.groupBy("row").agg(F.count(F.lit(1)).alias("own")), "row").where(F.lit(q) * F.col("own") > F.lit(q - p) * F.col("n"))
        return lists.join(checkpointed(lone.select("key")), "key", "left_anti")

    def _differences(self, lists: DataFrame) -> DataFrame:
        """``hub_key, key, n, hub_n, d, linked, extra, missing``: what the members of each list have beyond its hub, and what they lack of it."""
        hubs = lists.groupBy("token").agg(F.min(F.struct("own", "key"))["key"].alias("hub_key"))
        pairs = checkpointed(lists.join(hubs, "token").where("key != hub_key").select(F.col("hub_key").alias("a"), F.col("key").alias("b")).distinct())
        p, q = self.similarity

        def differ(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x, y in _text_pairs(batches, shingles):
                extra = [np.setdiff1d(t, s, assume_unique=True) for s, t in zip(x, y)]
                missing = [np.setdiff1d(s, t, assume_unique=True) for s, t in zip(x, y)]
                hub_n, n, more, less = (np.array([len(s) for s in sets], np.int64) for sets in (x, y, extra, missing))
                arrays = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *k]), pa.int32()), pa.array(np.concatenate(e).view(np.int64) if e else [], pa.int64())) for e, k in ((extra, more), (missing, less))]
                yield pa.RecordBatch.from_pydict(
                    {"hub_key": part.column(0), "key": part.column(1), "n": pa.array(n, pa.int32()), "hub_n": pa.array(hub_n, pa.int32()), "d": pa.array(more + less, pa.int32()),
                     "linked": pa.array((p + q) * (more + less) <= (q - p) * (n + hub_n)), "extra": arrays[0], "missing": arrays[1]}
                )

        return self._with_texts(pairs).mapInArrow(differ, "hub_key long, key long, n int, hub_n int, d int, linked boolean, extra array<long>, missing array<long>")

    def _difference_lists(self, sets: DataFrame) -> DataFrame:
        """Lists as of ``_postings``, of the rarest elements of each difference, by their exact counts around the hub.

        Of two members that a link joins one at least is not linked to the hub, or the hub connects them already. So the
        differences x and y of a link share ``(|x| + |y| - c (n + m)) / 2`` elements at least, c being the share of both
        sizes by which linked sets may differ. ``|y| >= 1`` and ``m <= hub_n + |y|`` bound that from below where x is not
        linked to the hub, ``|x| > c (n + hub_n)`` where y is: one at least in both cases. Before that, members go of whose
        sets too much is held by no other member at all: these link with none, like most that only share a passage.
        """
        p, q = self.similarity
        flagged = lambda c, new: F.transform(c, lambda x: F.struct(x.alias("element"), F.lit(new).alias("new")))
        each = sets.select("hub_key", "key", F.explode(F.concat(flagged("extra", True), flagged("missing", False))).alias("e")).select("hub_key", "key", "e.element", "e.new")
        counts = each.groupBy("hub_key", "element").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
        shared = each.join(counts, ["hub_key", "element"]).groupBy("hub_key", "key").agg(F.sort_array(F.collect_list(F.struct("count", "element"))).alias("shared_ones"), F.count_if("new").alias("shared_new"))
        unlinked = f"{p + q} * d - {q - p} * (n + hub_n) + {2 * p}"
        linked = f"{p + q} * d + {q - p} * (hub_n - n) + 1"
        least = F.expr(f"greatest(1, cast(ceil((CASE WHEN linked THEN {linked} ELSE {unlinked} END) / {2 * (p + q)}) AS int))")
        own = F.col("d") - F.size("shared_ones")
        held = F.col("n") - F.size("extra") + F.col("shared_new")
        rows = sets.join(shared, ["hub_key", "key"]).where(F.lit(q) * held >= F.lit(p) * F.col("n")).select(
            "hub_key", "key", "n", "d", "linked", own.alias("before"),
            F.slice("shared_ones", F.lit(1), F.greatest(F.lit(0), F.col("d") - least + 1 - own)).alias("prefix"),
        )
        lists = rows.select("hub_key", "key", "n", "d", "linked", "before", F.posexplode("prefix").alias("shared", "one"))
        return lists.select(F.xxhash64("hub_key", "one.element").alias("token"), "key", "n", "d", (F.col("before") + F.col("shared")).alias("place"), "shared", "linked")

    def _all_pairs(self, postings: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
        """Every pair on every posting list where the filters pass. Lists are cut into blocks, and each two blocks meet in a key of their own."""
        by_size = Window.partitionBy("token").orderBy("n", "key")
        nth = postings.withColumn("block", F.floor((F.row_number().over(by_size) - 1) / block))
        cut = nth.withColumn("last", F.max("block").over(Window.partitionBy("token")))
        names = ("key", "n", "place", "shared")
        left = cut.select("token", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), *[F.col(c).alias(f"x_{c}") for c in names])
        right = cut.select("token", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), *[F.col(c).alias(f"y_{c}") for c in names])
        met = left.join(right, ["token", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x_key") < F.col("y_key")))
        return self._suffix_filtered(met.where(_may_link("x_", "y_", self.similarity)).select(*_pairs("x_", "y_")).distinct())

    def all_links(self) -> DataFrame:
        """``a, b``: every link between two classes, also inside a component that other links connect."""
        again = _classes(self.docs, self.id_col, self.text_col, self.level, self.similarity).select("set_key", "prefix")
        postings = written(self._postings(self.classes.join(again, "set_key")))
        pairs = checkpointed(self._all_pairs(postings.table))
        postings.drop()
        return self._verified(pairs)

    def link_counts(self) -> DataFrame:
        """Per input row: ``doc_id, n_links``, how many other rows have an equal set or one that is linked. Wordless texts have none."""
        sizes = self.rows.where("set_key is not null").groupBy("set_key").agg(F.count(F.lit(1)).alias("size")).join(self.classes.select("set_key", "key"), "set_key")
        links = self.all_links()
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        far = ways.join(sizes.select(F.col("key").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("far"))
        counts = sizes.join(far, F.col("key") == F.col("a"), "left").select("set_key", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
        return self.rows.join(counts, "set_key", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

    def _suffix_filtered(self, pairs: DataFrame) -> DataFrame:
        p, q = self.similarity
        x = self.classes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("parts").alias("parts_a"))
        y = self.classes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("parts").alias("parts_b"))
        overlap = F.aggregate(F.zip_with("parts_a", "parts_b", lambda v, w: F.least(v, w)), F.lit(0), lambda s, v: s + v)
        return pairs.join(x, "a").join(y, "b").where(F.lit(p + q) * overlap >= F.lit(p) * (F.col("n_a") + F.col("n_b"))).select("a", "b")

    def _rows_about(self, wanted: DataFrame) -> DataFrame:
        """``text`` and the columns ``ROW`` of all rows that are ``wanted``, and of few others: a bitmap of those lets them through."""
        bits = min(MOST_BITMAP, max(LEAST_BITMAP, (BITS_EACH * wanted.count()).bit_length()))
        bit = F.pmod(F.xxhash64(*ROW), F.lit(1 << bits))
        held = wanted.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
        rows = _scan(self.docs, self.id_col, self.text_col, []).select("text", "text_key", *_plain_id(F.col("doc_id"))).withColumn("bit", bit)
        return rows.join(F.broadcast(held), F.expr("bit div 64 = word")).where("(shiftrightunsigned(bits, cast(bit % 64 AS int)) & 1) = 1")

    def _with_texts(self, pairs: DataFrame) -> DataFrame:
        """``a, b, text_a, text_b``. Each wanted text is shuffled once, and then once for each of its pairs.

        A bitmap that grows with the wanted texts keeps most others out of the shuffle. A text of more than ``SALT_PAIRS`` pairs
        is dealt to several tasks.
        """
        sides = F.explode(F.array(F.struct(F.col("a").alias("key"), F.lit(True).alias("is_a")), F.struct(F.col("b").alias("key"), F.lit(False).alias("is_a"))))
        asked = pairs.select("a", "b", sides.alias("side")).select("a", "b", "side.*")
        numbers = asked.groupBy("key").agg(F.count(F.lit(1)).alias("pairs"))
        names = ROW
        wanted = checkpointed(self.classes.join(numbers, "key").select("key", *_rep(), F.ceil(F.col("pairs") / SALT_PAIRS).cast("int").alias("salts")))
        rows = self._rows_about(wanted)
        heavy = F.broadcast(wanted.where("salts > 1").select(*names, "salts"))
        rows = rows.join(heavy, [*names], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        texts = rows.groupBy(*names, "salt").agg(F.first("text").alias("text"))
        asked = asked.join(wanted, "key").select("a", "b", "is_a", *names, F.pmod(F.xxhash64("a", "b"), "salts").cast("int").alias("salt"))
        met = texts.join(asked, [*names, "salt"])
        one = lambda is_a: F.max(F.when(F.col("is_a") == is_a, F.col("text")))
        return met.groupBy("a", "b").agg(one(True).alias("text_a"), one(False).alias("text_b"))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, by the exact size of intersection and union of both whole texts' shingles."""
        p, q = self.similarity

        def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x, y in _text_pairs(batches, exact_shingles):
                good = []
                for i, (s, t) in enumerate(zip(x, y)):
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    if q * shared >= p * (len(s) + len(t) - shared):
                        good.append(i)
                yield part.select(["a", "b"]).take(pa.array(good, pa.int64()))

        return checkpointed(self._with_texts(pairs).mapInArrow(verify, "a long, b long"))

    def keep_one(self) -> DataFrame:
        """The rows of ``docs`` less all but one of each component: the smallest id, null last, then a hash of the text.

        Rows without words stay, null and empty texts among them, and an empty table stays empty. Rows that repeat both id and text are the same document and stay or go together.
        """
        in_class = self.classes.join(self.components, self.classes["key"] == self.components["node"], "left")
        rank = F.struct(F.col("least_id").isNull().alias("last"), F.coalesce("least_id", F.lit(0)).alias("id"), F.col("least_text").alias("text"))
        best = in_class.groupBy(F.coalesce("component", "key").alias("c")).agg(F.min(rank).alias("best"))
        kept = checkpointed(best.select(F.when(~F.col("best.last"), F.col("best.id")).alias("__kept_id"), F.col("best.text").alias("__kept_text")))
        text = F.coalesce(F.col(self.text_col).cast("string"), F.lit(""))
        same = (F.xxhash64(text) == F.col("__kept_text")) & F.col(self.id_col).cast("long").eqNullSafe(F.col("__kept_id"))
        worded = text.rlike(WORD)
        return self.docs.where(worded).join(kept, same, "left_semi").unionByName(self.docs.where(~worded))

    def documents(self) -> DataFrame:
        """Per input row: ``doc_id, n_shingles, component_id``, the smallest doc_id reachable by links.

        Null, empty and wordless texts have no shingles and are alone. Equal sets are linked. Null ids are ignored where
        the smallest is sought; a component of null ids only has a null id. Repeated rows stay; an empty table gives an
        empty result; other columns are not looked at.
        """
        in_class = self.classes.join(self.components, self.classes["key"] == self.components["node"], "left").drop("node")
        in_class = in_class.withColumn("component", F.coalesce("component", "key"))
        least = in_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
        named = in_class.join(least, "component").select("set_key", "component_id")
        out = self.rows.join(named, "set_key", "left")
        lone = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), lone.alias("component_id"))
