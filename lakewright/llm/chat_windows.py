"""Operator 11: conversations as training windows of a token budget, with DataFrame functions only.

A turn is written as `<turn>role<turn:says>text</turn>` and a line feed. Within roles and texts each `<turn`
and `</turn` gets a backslash behind its `<`, and one that has backslashes there gets one more; so no text can
hold a marker, reading takes one backslash away again, and all other text stays as it is.

Turns are dealt out by conversation and block (BLOCK turn numbers), so one conversation of any length is
spread over tasks and the texts are shuffled once. Within a block the prefix sums of tokens place each turn at
`at`. With a budget, `history` tokens of it for repeated turns and a system turn of s tokens, room = budget -
history - s is left, and turns that begin within the same half of a room are a window:

* what begins in half k, with turns of half a room at most, ends before half k + 2: it has at most a room;
* repeated in front of it are the earlier turns that begin at most `history` tokens before half k, so both
  together take at most history and a room;
* a turn of over half a room is the last of its half and gets a window of its own, behind the turns that
  begin at most `history` tokens before it. If it is longer than a room, that window is over the budget
  (`over_budget`), as turns stay whole;
* the system turn is repeated in front of every window but the first.

The loss mask has the texts of target roles, each in the one window in which its turn isn't repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, SAYS, CLOSE = "<turn>", "<turn:says>", "</turn>\n"
#: What counts as a token: a run of ASCII letters and digits, or any other character that isn't white space.
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]"
#: Tokens of a turn's markers and role; turn numbers of a block.
FRAME, BLOCK = 4, 512


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def _rows(conversations: DataFrame, history: int, token: str) -> DataFrame:
    """The rows that each block needs: conv_id, block, kind (0 head, 1 history of the block before, 2 its
    own turn), first (of a head: whether the block is the conversation's first), turn, role, text, n.

    A head says that the conversation has several blocks, and repeats its system turn (else role is null).
    """
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("n", F.regexp_count("text", F.lit(token)) + FRAME)
    last = F.col("turn") - F.col("block") * BLOCK >= BLOCK - -(-history // FRAME)
    turns = own.withColumn("copy", F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    turns = turns.select("conv_id", (F.col("block") + F.col("copy")).alias("block"), (2 - F.col("copy")).alias("kind"), F.lit(None).cast("boolean").alias("first"), "turn", "role", "text", "n")

    blocks = own.groupBy("conv_id", "block").agg(F.min("turn").alias("turn"))
    # Null turns come first, as nulls do in an ascending order.
    ends = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("block", "turn")).alias("least")).where("many > 1")
    ends = ends.select(F.col("conv_id").alias("__c"), "least")
    system = own.where("role = 'system'").join(ends, F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("turn").eqNullSafe(F.col("least.turn"))).groupBy("conv_id").agg(F.min(F.struct("text", "n")).alias("system"))
    several = ends.join(system.withColumnRenamed("conv_id", "__s"), F.col("__c").eqNullSafe(F.col("__s")), "left").drop("__s")
    heads = blocks.join(several, F.col("conv_id").eqNullSafe(F.col("__c"))).select(
        "conv_id", "block", F.lit(0).alias("kind"), F.col("block").eqNullSafe(F.col("least.block")).alias("first"),
        F.col("least.turn").alias("turn"), F.when(F.col("system").isNotNull(), "system").alias("role"), F.col("system.text").alias("text"), F.coalesce("system.n", F.lit(0)).alias("n"),
    )
    return turns.unionByName(heads)


def windows(conversations: DataFrame, budget: int = 2048, history: int = 256, targets: tuple[str, ...] = ("assistant",), token: str = TOKEN) -> DataFrame:
    """The windows of conversations (conv_id, turn, role, text): conv_id, several (whether the conversation has
    several blocks), block, window (within the block; both ascend with the turns, with gaps), formatted,
    n_turns, n_repeated (so many turns in front are repeated), loss (begin and end of each masked text, in
    code points of formatted), n_tokens, over_budget.

    Turns are ordered by number, nulls first, then a system turn before others, then by role and text; equal
    rows are turns of their own. The first turn of a conversation is its system turn if its role is system.
    Null roles and texts count as empty, rows without a conv_id are one conversation; an empty table gives an
    empty one; further columns are ignored. Turns before a block that have numbers with gaps may make a
    shorter history at its begin.
    """
    part = W.partitionBy("conv_id", "block")
    later = F.coalesce((F.col("role") != "system").cast("int"), F.lit(0))
    order = part.orderBy("kind", F.col("turn").asc_nulls_first(), later, "role", "text")
    kind, is_head = F.col("kind"), F.col("kind") == 0
    rows = _rows(conversations, history, token)
    rows = rows.withColumn("head_first", F.max("first").over(part))
    # A system turn right before the block isn't its history too.
    again = F.max(F.when(is_head & F.col("role").isNotNull(), F.struct("turn", "text"))).over(part)
    rows = rows.withColumn("again", again).where("kind <> 1 or role <> 'system' or again is null or not (turn <=> again.turn and text = again.text)")
    rows = rows.withColumn("nth", F.row_number().over(order))
    starts = F.coalesce("head_first", F.lit(True))
    # The row of the system turn: the head's, or the conversation's own first row (behind the head, if any).
    own_first = (kind == 2) & starts & (F.col("role") == "system") & (F.col("nth") == F.when(F.col("head_first").isNull(), 1).otherwise(2))
    rows = rows.withColumn("system", F.when(is_head, F.col("role").isNotNull() & ~starts).otherwise(own_first))
    n = F.when(F.col("system") | is_head, 0).otherwise(F.col("n"))
    rows = rows.withColumn("before", F.sum(n).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - n)
    rows = rows.withColumn("at", F.col("before") - F.sum(F.when(kind == 1, F.col("n")).otherwise(0)).over(part))
    rows = rows.withColumn("s", F.max(F.when(F.col("system"), F.col("n")).otherwise(0)).over(part))
    rows = rows.withColumn("end", F.max(F.when(kind == 2, F.col("at"))).over(part))
    rows = rows.withColumn("half", F.greatest(F.lit(budget) - history - F.col("s"), F.lit(max(2, budget // 4))) / 2)
    rows = rows.where(~is_head | F.col("system"))
    bucket, reach = F.floor(F.col("at") / F.col("half")), F.floor((F.col("at") + history) / F.col("half"))
    first, last = (
        F.when(F.col("system"), F.lit(0)).when(kind == 1, F.lit(0)).otherwise(bucket),
        F.when(F.col("system"), F.floor(F.greatest("end", F.lit(0)) / F.col("half"))).when(kind == 1, reach).otherwise(F.greatest(bucket, reach)),
    )
    # 0 the system turn, 1 repeated, 2 fresh, 3 fresh and longer than half a room.
    role_of = F.when(F.col("system"), 0).when((kind == 1) | (F.col("bucket") > bucket), 1).when(F.col("n") > F.col("half"), 3).otherwise(2)
    rows = rows.withColumn("first_", first.cast("long")).withColumn("last_", last.cast("long")).where("last_ >= first_")
    rows = rows.withColumn("bucket", F.explode(F.sequence("first_", "last_"))).withColumn("as", role_of)
    turn = F.struct(F.when(F.col("system"), -1 - F.lit(1 << 40)).otherwise(F.col("at")).alias("at"), "as", "role", "text", "n")
    group = rows.groupBy("conv_id", "block", "bucket").agg(
        F.sort_array(F.collect_list(turn)).alias("t"), F.max("head_first").alias("head_first"),
    )
    opens = (F.col("bucket") == 0) & F.coalesce("head_first", F.lit(True))
    long_at = F.element_at(F.filter("t", lambda x: x["as"] == 3), 1)["at"]
    some = F.exists("t", lambda x: x["as"] == 2)
    fresh_head = F.when(opens & F.exists("t", lambda x: x["as"] == 0), 1).otherwise(0)

    group = group.withColumn("long_at", F.when(F.exists("t", lambda x: x["as"] == 3), long_at)).withColumn("some", some).withColumn("fresh_head", fresh_head)
    usual = F.filter("t", lambda x: x["as"] != 3)
    alone = F.filter("t", lambda x: (x["as"] == 0) | ((x["at"] >= F.col("long_at") - history) & (x["at"] <= F.col("long_at"))))
    two = F.array(
        F.struct(F.lit(0).alias("part"), usual.alias("turns"), (F.size(F.filter("t", lambda x: x["as"] < 2)) - F.col("fresh_head")).alias("n_repeated")),
        F.struct(F.lit(1).alias("part"), alone.alias("turns"), (F.size(alone) - 1 - F.when(F.col("some"), 0).otherwise(F.col("fresh_head"))).alias("n_repeated")),
    )
    made = group.withColumn("made", F.explode(F.filter(two, lambda x: F.when(x["part"] == 0, F.col("some") | (F.col("long_at").isNull() & (F.col("fresh_head") == 1))).otherwise(F.col("long_at").isNotNull()))))
    made = made.select("conv_id", F.col("head_first").isNotNull().alias("several"), "block", (2 * F.col("bucket") + F.col("made.part")).alias("window"), F.col("made.turns").alias("turns"), F.col("made.n_repeated").alias("n_repeated"))

    front = lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(SAYS))
    said = made.withColumn("said", F.transform("turns", lambda t: F.struct(front(t).alias("front"), escaped(t["text"]).alias("text"), t["role"].isin(*targets).alias("target"))))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    nothing = F.struct(F.lit(0).alias("at"), F.lit(0).alias("nth"), none.alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["front"])
        end = begin + F.char_length(x["text"])
        masked = x["target"] & (acc["nth"] >= F.col("n_repeated"))
        return F.struct((end + len(CLOSE)).alias("at"), (acc["nth"] + 1).alias("nth"), F.when(masked, F.concat(acc["spans"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["n"])
    return said.select(
        "conv_id", "several", "block", "window",
        F.array_join(F.transform("said", lambda x: F.concat(x["front"], x["text"], F.lit(CLOSE))), "").alias("formatted"),
        F.size("turns").alias("n_turns"), "n_repeated",
        F.aggregate("said", nothing, add, lambda acc: acc["spans"]).alias("loss"),
        tokens.alias("n_tokens"), (tokens > budget).alias("over_budget"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted window holds, read from it alone."""
    pieces = F.split(formatted, CLOSE)
    parts = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(F.substring(p, F.lit(len(OPEN) + 1), F.char_length(p)), SAYS, 2))
    return F.transform(parts, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))


def masked_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda x: unescaped(F.substring(formatted, x["begin"] + 1, x["end"] - x["begin"])))


def digest(made: DataFrame) -> DataFrame:
    """What can be read back from windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_windows, n_over_budget.

    Blocks are put together first; only conversations of several blocks send their texts on.
    """
    fresh = F.slice(turns_of(F.col("formatted")), F.col("n_repeated") + 1, F.greatest(F.col("n_turns") - F.col("n_repeated"), F.lit(0)))
    read = made.select(
        "conv_id", "several", "block", "window", fresh.alias("turns"), F.array_join(masked_texts(F.col("formatted"), F.col("loss")), "").alias("loss"),
        F.char_length("formatted").alias("chars"), F.col("over_budget").cast("long").alias("over"),
    )
    whole = read.select(
        "conv_id", "several", "block", "chars", "over", F.size("turns").alias("n"),
        F.struct("window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("text"), "loss").alias("piece"),
    )
    joined = lambda c, part: F.array_join(F.transform(c, lambda x: x[part]), "")
    blocks = whole.groupBy("conv_id", "several", "block").agg(
        F.sort_array(F.collect_list("piece")).alias("p"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("over").alias("over"), F.count(F.lit(1)).alias("windows"),
    ).select("conv_id", "several", "block", "n", "chars", "over", "windows", joined("p", "text").alias("text"), joined("p", "loss").alias("loss"))
    one = ~F.col("several")
    ready = blocks.select(
        "conv_id", "n", "chars", "over", "windows", F.char_length("loss").alias("loss_chars"),
        F.when(one, F.sha2("text", 256)).alias("text_sha"), F.when(one, F.sha2("loss", 256)).alias("loss_sha"),
        F.struct("block", F.when(~one, F.col("text")).alias("text"), F.when(~one, F.col("loss")).alias("loss")).alias("piece"),
    )
    long_ = lambda c: F.sum(c).cast("long")
    return ready.groupBy("conv_id").agg(
        long_("n").alias("n_turns"), F.max("text_sha").alias("t"), long_("loss_chars").alias("loss_chars"), F.max("loss_sha").alias("l"), long_("chars").alias("formatted_chars"),
        long_("windows").alias("n_windows"), long_("over").alias("n_over_budget"), F.sort_array(F.collect_list("piece")).alias("p"),
    ).select(
        "conv_id", "n_turns", F.coalesce("t", F.sha2(joined("p", "text"), 256)).alias("turns_sha256"), "loss_chars",
        F.coalesce("l", F.sha2(joined("p", "loss"), 256)).alias("loss_sha256"), "formatted_chars", "n_windows", "n_over_budget",
    )
