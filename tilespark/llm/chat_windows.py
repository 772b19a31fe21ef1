"""Chat formatting in budgeted windows, on DataFrame functions only.

Prefix sums of turn tokens cut a conversation into stretches of many windows' budgets, which are then worked on apart, and a
stretch into spans of whole turns, each as long as its window's budget allows. A window is the system turn, a limited history
before the span, and the span. The history is left out where it leaves the span's first turn no room, so a window exceeds the
budget only where the system turn and a single turn do. Only assistant turns of the span are under the loss mask, so a
repeated target is masked and each is learned once.

A turn is ``<|im_start|>role, line feed, text, <|im_end|>, line feed``. In texts each ``<``, any number of ``~`` and ``|``
get one ``~`` more, which leaves no control string and is undone exactly; in roles ``<`` and line feeds are rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
WINDOW_TOKENS = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 2
STRETCH_WINDOWS = 64


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<$1~|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def role_out(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("<"), F.lit("<~l")), F.lit("\n"), F.lit("<~n"))


def role_in(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("<~n"), F.lit("\n")), F.lit("<~l"), F.lit("<"))


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn, estimated at four bytes each, and four for its frame."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


def format_windows(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    window_tokens: int = WINDOW_TOKENS, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS,
    target_role: str = "assistant", system_role: str = "system", stretch_windows: int = STRETCH_WINDOWS,
) -> DataFrame:
    """One row per window: ``conv_id, first_turn, n_turns, repeated, tokens, formatted, loss_spans``.

    ``first_turn`` is the place in the conversation, from 0, of the first of the ``n_turns`` new turns; the ``repeated``
    turns before them are the system turn and the history. ``loss_spans`` are ``(start, length)`` in code points.

    Rows are ordered by turn, null first; ties by role, then text. Null roles and texts count as empty. Rows with a null
    conversation make one conversation. Repeated rows stay. An empty table gives an empty result. A conversation is read
    in order by one task, as a stream, for its prefix sums; the turns of a stretch, ``stretch_windows`` budgets and one turn
    at most, are then held together. A stretch's first span does not go on from the stretch before.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    turn = F.struct("role", "text", "tokens")
    first = F.first(turn).over(running)
    seen = (
        rows.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("after", F.sum("tokens").over(running))
        .withColumn("opening", first)
        .withColumn("past", F.array(*[F.lag(turn, k).over(order) for k in range(history_turns, 0, -1)]) if history_turns else F.array().cast("array<struct<role:string,text:string,tokens:bigint>>"))
    )
    # History: the last turns before a turn that fit, but not the system turn, which leads anyway.
    none = F.array().cast("array<struct<role:string,text:string,tokens:bigint>>")
    keeps_system = (F.col("opening.role") == system_role) & (F.col("place") > 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, t: x + t["tokens"])
    past = F.filter("past", lambda t, i: (F.col("place") - history_turns + i) >= F.when(F.col("opening.role") == system_role, 1).otherwise(0))
    fits = F.filter("past", lambda t, i: total(F.slice(F.col("past"), i + 1, F.size("past") - i)) <= history_tokens)
    seen = (
        seen.withColumn("past", past)
        .withColumn("past", fits)
        .withColumn("lead", F.when(keeps_system, F.col("opening.tokens")).otherwise(F.lit(0).cast("long")))
        .withColumn("with_past", total(F.col("past")))
        .withColumn("past", F.when(F.col("lead") + F.col("with_past") + F.col("tokens") <= window_tokens, F.col("past")).otherwise(none))
        .withColumn("stretch", F.call_function("div", F.col("after") - F.col("tokens"), F.lit(stretch_windows * window_tokens).cast("long")))
    )
    framed = F.struct("place", "role", "text", "tokens", "past", (F.col("lead") + total(F.col("past"))).alias("opens"))
    stretches = seen.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list(framed)).alias("all_turns"), F.first("opening").alias("opening"))
    # The places in the stretch at which spans begin; ``used`` is what the window so far takes.
    state = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, t: Column) -> Column:
        goes_on = (s["at"] > 0) & (s["used"] + t["tokens"] <= window_tokens)
        return F.struct(
            F.when(goes_on, s["used"] + t["tokens"]).otherwise(t["opens"] + t["tokens"]).alias("used"),
            (s["at"] + 1).alias("at"),
            F.when(goes_on, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["at"]))).alias("starts"),
        )

    starts = F.aggregate("all_turns", state, step, lambda s: s["starts"])
    spans = stretches.withColumn("starts", starts).select("conv_id", "opening", "all_turns", "starts", F.posexplode("starts").alias("nth", "start"))
    ends = F.coalesce(F.get("starts", F.col("nth") + 1), F.size("all_turns"))
    spans = spans.select("conv_id", "opening", F.slice("all_turns", F.col("start") + 1, ends - F.col("start")).alias("turns"))
    place = F.col("turns")[0]["place"]
    system = F.when((F.col("opening.role") == system_role) & (place > 0), F.array("opening")).otherwise(none)
    lead = F.concat(system, F.col("turns")[0]["past"])
    head = lambda t: F.concat(F.lit(START), role_out(t["role"]), F.lit("\n"))
    piece = lambda t, new: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (new & (t["role"] == target_role)).alias("loss"), t["tokens"].alias("tokens"))
    pieces = F.concat(F.transform("again", lambda t: piece(t, F.lit(False))), F.transform("turns", lambda t: piece(t, F.lit(True))))
    no_spans = F.array().cast("array<struct<start:bigint,length:bigint>>")
    body_at = lambda s, p: s["at"] + F.length(p["head"])
    span = lambda s, p: F.struct(body_at(s, p).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))
    spans_of = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), no_spans.alias("spans")),
        lambda s, p: F.struct(
            (body_at(s, p) + F.length(p["body"]) + len(END)).cast("long").alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(span(s, p)))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return (
        spans.withColumn("again", lead)
        .withColumn("pieces", pieces)
        .select(
            "conv_id",
            place.cast("long").alias("first_turn"),
            F.size("turns").cast("long").alias("n_turns"),
            F.size("again").alias("repeated"),
            total(F.col("pieces")).alias("tokens"),
            F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
            spans_of.alias("loss_spans"),
        )
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Parse formatted windows: per window the new ``turns`` (role, text) and ``loss_text``, the unescaped text under the mask.

    Empty texts come back empty, null ones too; a window without targets has an empty ``loss_text``; no windows give no rows.
    """
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("repeated") + 2, F.greatest(F.col("n_turns").cast("int"), F.lit(0)))

    def parsed(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(role_in(role).alias("role"), unescaped(body).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.withColumn("turns", F.transform(parts, parsed)).withColumn("loss_text", F.array_join(masked, ""))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    A digest is of a conversation's whole text, so that text is one row's; no windows give no rows.
    """
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_windows(windows).select(
        "conv_id",
        F.struct("first_turn", F.size("turns").cast("long").alias("n"), told.alias("told"), "loss_text", F.length("formatted").cast("long").alias("chars")).alias("w"),
    )
    joined = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    whole = lambda f: F.array_join(F.transform("ws", lambda w: w[f]), "")
    total = lambda f: F.aggregate("ws", F.lit(0).cast("long"), lambda x, w: x + w[f])
    return joined.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(whole("told").cast("binary"), 256).alias("turns_sha256"),
        F.length(whole("loss_text")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss_text").cast("binary"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
