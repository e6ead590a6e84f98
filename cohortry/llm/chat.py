"""Chat formatting in budgeted windows, with DataFrame functions only.

Template. A turn is `<|turn|>role<|text|>text<|end|>` and a newline. Inside roles and texts, a backslash becomes two and `<|`
becomes `<\\|`, so marks never occur in them; reading reverses this exactly.

Windows. A conversation's turns are taken in order of turn, role and text (ties by the text's first characters, then its
hash). All turns are put in order once by ranges, whatever their numbers; blocks are runs of up to `BLOCK_TURNS` of them, so no task
holds more of one conversation. Prefix sums of a block's tokens choose its windows: a window's new turns end before the first
that would take it beyond what the budget leaves after the system turn and history. The last window of a block and the first
of the next are one where that fits. Each window shows the conversation's system turn (its first turn, if a system turn of up to
half of the budget; a longer one is a turn like others, shown once), then the last turns before the window that fit into `history`
tokens (at most `HISTORY_TURNS`), then its new turns. Where a new turn doesn't fit beside them, history and then the system turn
are left out; a turn that is over the budget alone has a window of its own, the only kind that may pass the budget.
Repeats, system turn included, are masked: only new turns of `target` roles are under the loss mask, so each is a target once.
Tokens are counted as words and single marks of punctuation.

Null roles and texts count as empty, null turns come first, a null conversation is one, repeated rows are turns of their own, an
empty table gives an empty result, other columns play no part. Texts may have any length; a turn is never split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import saved

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
BUDGET, HISTORY, HISTORY_TURNS = 512, 128, 64
#: Turns in a block (a power of two).
BLOCK_TURNS = 1024
ROLE = "struct<turn: bigint, role: string, text: string, tokens: bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    # a single backslash stands only between < and |; all others come in pairs
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _tokens(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda s, t: s + t["tokens"])


def _tail(turns: Column, most: Column | int) -> Column:
    """The last turns with up to `most` tokens together."""
    total = _tokens(turns)
    kept = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("drop")),
        lambda s, t: F.struct((s["sum"] + t["tokens"]).alias("sum"), F.when(total - s["sum"] > most, s["drop"] + 1).otherwise(s["drop"]).alias("drop")),
    )["drop"]
    return F.slice(turns, kept + 1, F.size(turns))


def blocks(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, block (rising in a conversation), turns: all turns in order, in runs of up to block_turns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.regexp_count(text("text"), F.lit(TOKEN)).cast("long").alias("tokens"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("t"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("conv_id", "t", F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), F.substring("t.text", 1, 64).alias("head"), F.xxhash64("t.text").alias("hash"), "row")
    order = ["conv_id", "turn", "role", "head", "hash", "row"]
    # within a partition the id counts rows, and partitions are in order
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t", F.monotonically_increasing_id().alias("at"))
    block = F.floor(F.col("at") / block_turns)
    found = at.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("x"))
    return saved(found.select("conv_id", "block", F.transform("x", lambda x: x["t"]).alias("turns")), "turns")


def _spans(tokens: Column, room: Column) -> Column:
    """(start, size, tokens) of each window over an array of tokens, by their running sum."""
    kind = "array<struct<start: int, size: int, tokens: bigint>>"
    none, zero = F.array().cast(kind), F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), zero.alias("sum"), none.alias("out"))
    span = lambda s: F.array(F.struct(s["start"].alias("start"), (s["i"] - s["start"]).alias("size"), s["sum"].alias("tokens")))

    def step(s: Column, n: Column) -> Column:
        over = (s["sum"] + n > room) & (s["i"] > s["start"])
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(over, s["i"]).otherwise(s["start"]).alias("start"), F.when(over, n).otherwise(s["sum"] + n).alias("sum"),
            F.when(over, F.concat(s["out"], span(s))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(tokens, start, step, lambda s: F.concat(s["out"], span(s)))


def plan(found: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, block, system, carried (turns before the block that fit the history), own (the block starts with the system turn),
    spans (its windows), after (the block and window that its first one is part of, or null), before (its last one has a part in the next).

    Apart from a bounded history only numbers travel by conversation.
    """
    none = F.array().cast(f"array<{ROLE}>")
    first = F.get("turns", F.lit(0))
    is_system = (first["role"] == "system") & (first["tokens"] <= budget // 2)
    tail = _tail(F.slice("turns", F.greatest(F.size("turns") - HISTORY_TURNS + 1, F.lit(1)), HISTORY_TURNS), history)
    slim = found.select("conv_id", "block", F.col("turns.tokens").alias("tokens"), F.when(is_system, F.array(first)).otherwise(none).alias("first"), tail.alias("tail"))
    order = W.partitionBy("conv_id").orderBy("block")
    earlier = [F.coalesce(F.lag("tail", k).over(order), none) for k in (4, 3, 2, 1)]
    slim = slim.select(
        "conv_id", "block", "tokens", F.first("first").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("system"),
        F.concat(*earlier).alias("carried"), (F.row_number().over(order) == 1).alias("lead"),
    )
    slim = slim.withColumn("own", F.col("lead") & (F.size("system") > 0)).withColumn("room", F.lit(budget) - _tokens(F.col("system")) - history)
    slim = slim.withColumn("tokens", F.when(F.col("own"), F.slice("tokens", F.lit(2), F.size("tokens"))).otherwise(F.col("tokens")))
    slim = slim.withColumn("spans", _spans(F.col("tokens"), F.col("room")))
    # a system turn that the first new turn doesn't fit beside has a window of its own
    alone = F.col("own") & (F.get("spans", F.lit(0))["size"] > 0) & (F.get("spans", F.lit(0))["tokens"] + _tokens(F.col("system")) > budget)
    empty = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("tokens")))
    slim = slim.withColumn("spans", F.when(alone, F.concat(empty, F.col("spans"))).otherwise(F.col("spans"))).withColumn("n", F.size("spans"))
    last = F.element_at("spans", -1)["tokens"]
    slim = slim.withColumn("fits", F.coalesce(F.lag(last).over(order) + F.get("spans", F.lit(0))["tokens"] <= F.col("room"), F.lit(False)))
    # of a block's one window, the edge before goes first, so that no window has three parts
    joins = F.col("fits") & ((F.lag("n").over(order) > 1) | ~F.lag("fits").over(order))
    slim = slim.withColumn("after", F.when(joins, F.struct(F.lag("block").over(order).alias("block"), (F.lag("n").over(order) - 1).alias("window"))))
    slim = slim.withColumn("before", F.coalesce(F.lead(F.col("after").isNotNull()).over(order), F.lit(False)))
    return slim.select("conv_id", "block", "system", _tail(F.col("carried"), history).alias("carried"), "own", "spans", "after", "before")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, block, window, system, system_is_new, repeated, new: the turns of each window."""
    found = blocks(turns, block_turns)
    to = plan(found, budget, history).withColumnsRenamed({"conv_id": "c", "block": "b"})
    out = found.join(to, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    # the system turn is shown by itself, also where it lies in the block
    out = out.withColumn("turns", F.when(F.col("own"), F.slice("turns", F.lit(2), F.size("turns"))).otherwise(F.col("turns")))

    def window(span: Column, i: Column) -> Column:
        start = F.greatest(span["start"] - HISTORY_TURNS, F.lit(0))
        near = F.slice("turns", start + 1, span["start"] - start)
        past = F.when(start > 0, near).otherwise(F.concat("carried", near))
        joined = (i == 0) & F.col("after").isNotNull()
        return F.struct(
            F.when(joined, F.col("after.block")).otherwise(F.col("block")).alias("block"), F.when(joined, F.col("after.window")).otherwise(i).alias("window"),
            (joined | (F.col("before") & (i == F.size("spans") - 1))).alias("parted"), joined.alias("second"),
            ((i == 0) & F.col("own")).alias("system_is_new"), past.alias("past"), F.slice("turns", span["start"] + 1, span["size"]).alias("new"),
        )

    out = out.select("conv_id", "system", F.inline(F.transform("spans", window)))
    parts = F.sort_array(F.collect_list(F.struct("second", "system", "system_is_new", "past", "new")))
    joined = out.where("parted").groupBy("conv_id", "block", "window").agg(parts.alias("p"))
    whole = F.get("p", F.lit(0))
    joined = joined.select("conv_id", "block", "window", whole["system"].alias("system"), whole["system_is_new"].alias("system_is_new"), whole["past"].alias("past"), F.flatten(F.col("p.new")).alias("new"))
    out = out.where("not parted").drop("parted", "second").unionByName(joined)
    # a system turn in the carried history is shown once, at the top; what doesn't fit beside the new turns is left out
    past = F.filter("past", lambda t: ~F.coalesce(t.eqNullSafe(F.get("system", F.lit(0))), F.lit(False)))
    shown = F.col("system_is_new") | (_tokens(F.col("system")) + F.col("used") <= budget)
    out = out.withColumn("used", _tokens(F.col("new")))
    out = out.withColumn("system", F.when(shown, F.col("system")).otherwise(F.array().cast(f"array<{ROLE}>")))
    left = F.least(F.lit(history), F.lit(budget) - F.col("used") - _tokens(F.col("system")))
    return out.select("conv_id", "block", "window", "system", "system_is_new", _tail(past, F.greatest(left, F.lit(0))).alias("repeated"), "new")


def format_chat(turns: DataFrame, target: tuple[str, ...] = ("assistant",), **how) -> DataFrame:
    """conv_id, block, window, formatted, n_repeated (turns at the top that an earlier window holds), loss: spans (start, length) in code points.

    A conversation's windows in order of (block, window) hold each turn once as a new one.
    """
    out = windows(turns, **how)
    every = F.concat("system", "repeated", "new")
    old = (F.size("system") + F.size("repeated")).alias("old")
    out = out.select("conv_id", "block", "window", every.alias("turns"), old, (F.size("repeated") + F.when(F.col("system_is_new"), 0).otherwise(F.size("system"))).alias("n_repeated"), "system_is_new")
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    out = out.withColumn("pieces", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), t["role"].alias("role"))))
    out = out.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"), F.lit(0).alias("i"))

    def step(s: Column, p: Column) -> Column:
        start, size = s["at"] + F.length(p["head"]), F.length(p["body"])
        new = (s["i"] >= F.col("old")) | (F.col("system_is_new") & (s["i"] == 0))
        span = F.when(new & p["role"].isin(*target), F.array(F.struct(start.alias("start"), size.alias("length")))).otherwise(F.array().cast("array<struct<start: int, length: int>>"))
        return F.struct((start + size + len(END)).alias("at"), F.concat(s["spans"], span).alias("spans"), (s["i"] + 1).alias("i"))

    return out.select("conv_id", "block", "window", "formatted", "n_repeated", "system_is_new", F.aggregate("pieces", state, step)["spans"].alias("loss"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, block, window, turns (role, text) new in the window, loss (the texts under the mask), formatted_chars: read from the output."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")
    turn = lambda x: F.struct(unescape(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), TEXT, 1)).alias("role"), unescape(F.substring_index(x, TEXT, -1)).alias("text"))
    out = formatted.withColumn("parts", parts)
    lead = F.when(F.col("system_is_new"), F.slice("parts", F.lit(1), F.lit(1))).otherwise(F.array().cast("array<string>"))
    # when the system turn is new it comes first, and the repeated turns follow it
    rest = F.slice("parts", F.col("n_repeated") + F.size(lead) + 1, F.size("parts"))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return out.select("conv_id", "block", "window", F.transform(F.concat(lead, rest), turn).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """The contract's row of each conversation, from what was read back. A digest needs all of its conversation's text in one value."""
    part = F.struct("block", "window", "turns", "loss")
    one = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("w"), F.sum("formatted_chars").alias("formatted_chars"), F.sum(F.size("turns")).cast("long").alias("n_turns"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    said = F.array_join(F.transform("w", lambda w: F.array_join(F.transform(w["turns"], line), "")), "")
    learnt = F.array_join(F.transform("w", lambda w: F.array_join(w["loss"], "")), "")
    one = one.select("conv_id", "n_turns", "formatted_chars", said.alias("said"), learnt.alias("learnt"))
    return one.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")
