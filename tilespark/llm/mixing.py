"""Mixing sources to target weights by Sainte-Laguë apportionment, on DataFrame functions only.

Every source is dealt by a seeded hash into shards of about ``shard_rows`` documents. A shard's words, its documents laid
end to end in a seeded order, are cut into blocks, of equal word counts in all shards of a source. Blocks are the seats:
highest quotients allot them first to sources by target, then to the shards of each source by size, so each shard has an
integer quota. Where there are many sources, or many shards of a source, seats go to groups of ``GROUP`` neighbours first and
then inside each group, so no task ranks more than one group or the groups. A shard whose
quota is ``q`` over ``n`` blocks takes every block ``q div n`` times and ``q mod n`` blocks, chosen by a seeded systematic
draw, once more. As the draw has a closed form, a document's share follows from its place in the shard alone: no block is
ever made a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, broadcast_if_small, checkpointed

BLOCK_WORDS = 2048
LEAST_BLOCKS = 64
SHARD_ROWS = 1024
GROUP = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2.0


def _hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def target_words(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """``source, source_size, rank, target`` from ``source, source_size``.

    Sources in code point order, null last, take the weights in turn; ``rank`` is their place in it. The targets sum to
    ``share`` of all words; none is above ``most`` times its source's size, and what is cut off goes to the others by weight:
    targets are ``min(most * size, level * weight)`` for the one level that sums up, or ``most * size`` if none does. The level
    rises to it in rounds, each a sum over all sources, as those that are cut off grow; no task holds the sources in order.
    """
    ordered = checkpointed(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).select("source", "source_size", F.monotonically_increasing_id().alias("__id"))
    )
    ordered = ordered.withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))  # a row per partition
    rank = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = ordered.join(F.broadcast(offsets.drop("__n")), "__part").withColumn("rank", rank).withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = checkpointed(t.select("source", "source_size", "rank", "weight", "cap"))
    goal = (t.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        now = t.agg(F.count(F.when(over, 1)).alias("n"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("caps"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if now.n == capped or not now.free:
            break
        capped, level = now.n, max(level, (goal - now.caps) / now.free)
    target = F.col("cap") if not now.free else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return t.select("source", "source_size", "rank", target.alias("target"))


def highest_quotients(parties: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """``parties`` (``votes``, ``house``, ``most_seats``) with ``seats``: Sainte-Laguë seats of each party within its group's house.

    The seats that a party surely gets are given outright, so only a few quotients a party are ranked. No party gets more than
    its ``most_seats`` (null: no limit); the next quotients win what it would have had.
    """
    limit = F.coalesce(F.col("most_seats"), F.lit(1 << 62)).cast("long")
    w = Window.partitionBy(*group)
    ideal = F.when(F.col("__all") > 0, F.col("votes") * F.col("house") / F.col("__all")).otherwise(F.lit(0.0))
    swing = F.when(F.col("__all") > 0, F.col("votes") * F.col("__parties") / F.col("__all")).otherwise(F.lit(0.0))
    base = (
        parties.withColumn("__all", F.sum("votes").over(w))
        .withColumn("__parties", F.count(F.lit(1)).over(w))
        .withColumn("__low", F.least(limit, F.greatest(F.floor(ideal - swing) - 1, F.lit(0)).cast("long")))
        .withColumn("__high", F.least(limit, (F.ceil(ideal + 2 * swing) + 2).cast("long")))
    )
    order = Window.partitionBy(*group).orderBy(F.desc("__quotient"), *key, "__seat")
    ranked = (
        base.withColumn("__left", F.col("house") - F.sum("__low").over(w))
        .withColumn("__seat", F.explode(F.sequence("__low", "__high")))
        .withColumn("__quotient", F.when(F.col("__seat") < limit, F.col("votes") / (2 * F.col("__seat") + 1)).otherwise(F.lit(-1.0)))
        .withColumn("__place", F.row_number().over(order))
    )
    by = list(dict.fromkeys([*group, *key]))
    first = [F.first(c).alias(c) for c in parties.columns if c not in by]
    won = F.count(F.when((F.col("__place") <= F.col("__left")) & (F.col("__quotient") > 0), 1))
    return ranked.groupBy(*by).agg(*first, (F.first("__low") + won).alias("seats"))


def quotients_in_groups(parties: DataFrame, group: list[str], key: str, size: int = GROUP) -> DataFrame:
    """As ``highest_quotients``, with seats for runs of ``size`` neighbours by the number ``key`` first and then inside each."""
    runs = parties.withColumn("__run", _div(F.col(key).cast("long"), F.lit(size).cast("long")))
    whole = runs.groupBy(*group, "__run").agg(F.sum("votes").alias("votes"), F.first("house").alias("house"), F.sum("most_seats").alias("most_seats"))
    houses = highest_quotients(whole, group, ["__run"]).select(*[F.col(c).alias(f"__of_{c}") for c in group], F.col("__run").alias("__of_run"), F.col("seats").alias("__house"))
    same = F.col("__run") == F.col("__of_run")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    inside = runs.join(houses, same).drop("__of_run", *[f"__of_{c}" for c in group]).withColumn("house", F.col("__house")).drop("__house")
    return highest_quotients(inside, [*group, "__run"], [key]).drop("__run")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _drawn_before(k: Column) -> Column:
    """Of the first ``k`` blocks of the shard, how many the draw takes once more: a block is drawn where the count steps."""
    n, r, t = F.col("n_blocks"), F.col("extra"), F.col("turn")
    return F.when(n > 0, _div((k + t) * r, n) - _div(t * r, n)).otherwise(F.lit(0).cast("long"))


def _taken_before(word: Column) -> Column:
    """Words taken among the first ``word`` of the shard."""
    b = F.col("block")
    k = _div(word, b)
    return F.col("whole") * word + _drawn_before(k) * b + (_drawn_before(k + 1) - _drawn_before(k)) * F.pmod(word, b)


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False,
    weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, block_words: int = BLOCK_WORDS,
    least_blocks: int = LEAST_BLOCKS, shard_rows: int = SHARD_ROWS, seed: int = 7,
) -> DataFrame:
    """Per input row: ``doc_id, size, source, source_size, target, taken`` and where it lies among its shard's blocks.

    ``begins`` is the document's first word in its shard; the shard's blocks are of ``block`` words each, but for a shorter
    last one; ``whole`` is how often every block is taken, and of ``n_blocks`` blocks ``extra`` are taken once more, drawn
    from the rotation ``turn`` on. ``carry`` adds the input row as the struct ``row``.

    Null texts have size 0; a null source is a source of its own; repeated rows are mixed each for itself; sources without
    words have target 0; an empty table gives an empty result. A source's words differ from its target by about a block a
    shard at most; a block is ``block_words`` or, in small sources, ``1 / least_blocks`` of a shard's words on average.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_key"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    sized = checkpointed(rows.drop("row"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = checkpointed(sources.withColumn("shards", F.ceil(F.col("rows") / F.lit(shard_rows)).cast("long")))
    n_shards = broadcast_if_small(sources.select(F.col("source").alias("s_source"), "shards"))

    def dealt(table: DataFrame) -> DataFrame:
        out = table.join(n_shards, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
        return out.withColumn("shard", F.pmod(_hash(seed, F.col("doc_id"), F.col("text_key")), F.col("shards")))

    block = F.greatest(F.lit(1), F.least(F.lit(block_words), _div(F.col("source_size"), F.col("shards") * least_blocks))).cast("long")
    targets = target_words(sources.select("source", "source_size"), weights, share, most)
    blocks_of = broadcast_if_small(checkpointed(sources.select(F.col("source").alias("k_source"), block.alias("block"))))
    shards = dealt(sized).groupBy("source", "shard").agg(F.sum("size").alias("shard_words"))
    shards = shards.join(blocks_of, F.col("source").eqNullSafe(F.col("k_source"))).drop("k_source")
    shards = checkpointed(shards.withColumn("n_blocks", F.ceil(F.col("shard_words") / F.col("block")).cast("long")))
    blocks = shards.groupBy(F.col("source").alias("b_source")).agg(F.sum("n_blocks").alias("source_blocks"))
    seats = F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    limit = lambda n: (F.col(n) * F.lit(float(most))).cast("long")
    votes = checkpointed(targets.join(blocks, F.col("source").eqNullSafe(F.col("b_source"))).drop("b_source").withColumn("votes", seats).withColumn("most_seats", limit("source_blocks")))
    house = round(votes.agg(F.sum("votes")).first()[0] or 0)
    won = quotients_in_groups(votes.withColumn("house", F.lit(house).cast("long")).withColumn("mix", F.lit(1)), ["mix"], "rank").select(
        F.col("source").alias("w_source"), "source_size", "target", F.col("seats").alias("house"),
    )
    parties = shards.join(won, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source").withColumn("votes", F.col("n_blocks").cast("double")).withColumn("most_seats", limit("n_blocks"))
    quotas = quotients_in_groups(parties, ["source"], "shard")
    n, quota = F.col("n_blocks"), F.col("seats")
    quotas = checkpointed(
        quotas.select(
            F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "source_size", "target", "block", "n_blocks",
            F.when(n > 0, _div(quota, n)).otherwise(F.lit(0)).cast("long").alias("whole"),
            F.when(n > 0, F.pmod(quota, n)).otherwise(F.lit(0)).cast("long").alias("extra"),
            F.when(n > 0, F.pmod(_hash(seed + 1, F.col("source"), F.col("shard")), n)).otherwise(F.lit(0)).cast("long").alias("turn"),
        )
    )
    place = Window.partitionBy("source", "shard").orderBy(_hash(seed + 2, F.col("doc_id"), F.col("text_key")), "doc_id", "text_key", "size")
    laid = dealt(rows if carry else sized)
    laid = laid.withColumn("begins", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = laid.join(broadcast_if_small(quotas), F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    taken = _taken_before(F.col("begins") + F.col("size")) - _taken_before(F.col("begins"))
    return placed.select(
        "doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"),
        "begins", "block", "n_blocks", "whole", "extra", "turn", *(["row"] if carry else []),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed documents, in the columns of ``docs``: a row for each whole copy, and one for the words of drawn blocks.

    A drawn row's text has the words of the drawn blocks with the white space before each; documents without a word taken
    go, null texts among them; a null source is mixed like any other, repeated rows each for itself, and an empty table stays
    empty. ``n_chars``, if it is a column, follows the text.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, carry=True, **settings)
    first, last = _div(F.col("begins"), F.col("block")), _div(F.col("begins") + F.col("size") - 1, F.col("block"))
    drawn = F.filter(F.sequence(first, last), lambda k: _drawn_before(k + 1) > _drawn_before(k))
    words = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))

    def part(k: Column) -> Column:
        begin = F.greatest(k * F.col("block") - F.col("begins"), F.lit(0).cast("long"))
        end = F.least((k + 1) * F.col("block") - F.col("begins"), F.col("size"))
        return F.array_join(F.slice(F.col("words"), (begin + 1).cast("int"), (end - begin).cast("int")), "")

    whole = plan.where("size > 0 and whole > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("whole").cast("int"))))
    whole = whole.select(F.col("row"), F.col(f"row.{text_col}").alias("part"))
    some = plan.where("size > 0 and extra > 0").withColumn("drawn", drawn).where("size(drawn) > 0").withColumn("words", words)
    some = some.select("row", F.concat_ws("", F.transform("drawn", part)).alias("part"))
    both = whole.unionByName(some)
    return both.select(*[_mixed(c, docs, text_col) for c in docs.columns])


def _mixed(column: str, docs: DataFrame, text_col: str) -> Column:
    if column == text_col:
        return F.col("part").alias(column)
    if column == "n_chars":
        return F.length("part").cast(docs.schema[column].dataType).alias(column)
    return F.col("row").getField(column).alias(column)
