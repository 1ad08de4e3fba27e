"""Chat formatting in budgeted windows, in built-in expressions only.

A conversation's turns, in order, are laid end to end in tokens; prefix sums say where each starts and ends. What a system
turn leaves of the budget is room for others; a part of it, ``history_tokens`` but a quarter of the room at most, is for
repeated turns, and the rest is the stride. The line is cut at multiples of the stride, and turns that end in one stretch
form a window: turns are never cut. A turn that reaches into a stretch from the one before joins that stretch's window
only if all of it fits the stride, and is else a window of its own. Each window starts with the conversation's system turn,
then repeats turns before it as far as history and what its own turns leave of the room allow; repeated turns are context,
and only a window's own assistant texts are under the loss. So a window keeps to the budget, but for one whose only own
turn, with the system turn, doesn't: that is marked over_budget.

Tokens are estimated as a quarter of the UTF-8 bytes, with TURN_TOKENS for the marks; ``tokens`` takes another column.

Texts travel twice: to the block of turns that they are sorted in, and to their windows. Prefix sums run over blocks first
and then over block totals; windows are planned on numbers alone, and their plan comes back to the blocks. A block is
BLOCK_TURNS numbers of turns; where more than HOT_TURNS rows fall in one (turns repeated, or without a number), it is
divided by turn, role and the first characters of the text. Equal rows of one conversation are sorted in one task.

Template: ``### role:``, a line break, the text, a line break, ``</turn>``, a line break. Inside texts and roles a
backslash goes before each backslash, ``###`` and ``</turn>``, so a bare mark is always the template's.

Defined results: null texts and roles are empty; turns are ordered by turn (nulls first), then role and text, so
repeated rows are turns of their own; rows with a null conv_id form one conversation; a system turn beyond the budget
leaves every window over it; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, few_tasks, small, table

TURN_TOKENS = 8
BLOCK_TURNS = 256
HOT_TURNS = 2048
PREFIX_CHARS = 12
#: Fixed value: the probe conversation's text.
PROBE = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|###|</turn>)", "$1")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def _rows(turns: DataFrame, tokens) -> DataFrame:
    """Turns with key, the conversation as a string, block, in which they are sorted, and n, their tokens."""
    rows = turns.select(
        # A null is a conversation of its own, unlike any value.
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("key"),
        "turn",
        F.floor(F.col("turn") / BLOCK_TURNS).alias("_block"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    hot = rows.groupBy("key", F.coalesce("_block", F.lit(-(1 << 60))).alias("_at")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_TURNS).select("key", "_at")
    steps = Steps(turns.sparkSession)
    hot, found = steps.store(hot, few_tasks(turns.sparkSession), n=F.count(F.lit(1)))
    if found["n"]:
        rows = rows.withColumn("_at", F.coalesce("_block", F.lit(-(1 << 60)))).join(small(hot.withColumn("_hot", F.lit(True)), found["n"]), ["key", "_at"], "left")
        part = F.when(F.col("_hot"), F.struct("turn", "role", F.substring("text", 1, PREFIX_CHARS).alias("prefix")))
    else:
        steps.clear()
        part = F.lit(None).cast(T.StructType([turns.schema["turn"], T.StructField("role", T.StringType()), T.StructField("prefix", T.StringType())]))
    rows = rows.withColumn("block", F.struct(F.col("_block").alias("number"), part.alias("part")))
    return rows.select("key", "block", "turn", "role", "text", (tokens(F.col("text")) + TURN_TOKENS).cast("long").alias("n"))


def windows(turns: DataFrame, max_tokens: int = 1024, history_tokens: int = 256, tokens=estimated_tokens) -> DataFrame:
    """Formatted windows.

    Columns: conv_id, window (token at which its own turns start), n_tokens, over_budget, text, and turns, an array of
    (idx, repeated, loss, start, text_start, text_end, end): code points of each turn and of its text in the window.
    """
    in_block = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    base = _rows(turns, tokens)
    # All uses of rows take the same columns, so that texts are sorted once.
    rows = base.withColumn("i", F.row_number().over(in_block)).withColumn("_end", F.sum("n").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    is_system = (F.col("i") == 1) & (F.col("role") == "system")
    blocks = rows.groupBy("key", "block").agg(F.sum("n").alias("_sum"), F.count("*").alias("_count"), F.max(F.when(is_system, F.col("n"))).alias("_system"))
    by_block = Window.partitionBy("key").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "key", "block",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_tokens"),
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_turns"),
        # Only the first turn of a conversation can be its system turn.
        F.first("_system").over(by_block).alias("system_n"),
    )
    light = rows.select("key", "block", "i", "n", "_end").join(blocks, ["key", "block"])
    room = F.greatest(F.lit(max_tokens) - F.coalesce("system_n", F.lit(0)), F.lit(1))
    placed = light.select(
        "key", "block", "i", "n", "system_n",
        (F.col("_turns") + F.col("i") - 1).alias("idx"),
        (F.col("_tokens") + F.col("_end") - F.col("n")).alias("at"),
        (F.col("_tokens") + F.col("_end")).alias("to"),
        room.alias("room"),
        F.least(F.lit(history_tokens), F.floor(room / 4)).alias("history"),
    )
    placed = placed.withColumn("stride", F.greatest(F.col("room") - F.col("history"), F.lit(1))).withColumn("bucket", F.floor((F.col("to") - 1) / F.col("stride")))
    # The turns that end in one stretch: at most stride tokens, and one turn that comes from before.
    stretch = Window.partitionBy("key", "bucket")
    crosses = F.col("at") < F.col("bucket") * F.col("stride")
    placed = placed.withColumn("alone", crosses & (F.sum("n").over(stretch) > F.col("stride")))
    window = Window.partitionBy("key", "bucket", "alone")
    placed = placed.withColumn("window", F.min("at").over(window)).withColumn("own_n", F.sum("n").over(window))
    own = placed.select("key", "block", "i", "idx", "window", F.lit(False).alias("repeated"))
    allowed = F.greatest(F.lit(0), F.least(F.col("history"), F.col("room") - F.col("own_n")))
    starts = placed.where(F.col("at") == F.col("window")).select("key", "window", "system_n", "idx", allowed.alias("allowed"))
    # Interval join: a turn is history of the windows that start within what they allow after its start. Turns and
    # windows meet in bins of history_tokens, of which a turn touches three at most.
    bin_of = lambda c: F.floor(c / max(1, history_tokens))
    is_first_system = (F.col("idx") == 0) & F.col("system_n").isNotNull()
    candidates = placed.where((F.col("n") <= history_tokens) & ~is_first_system).select("key", "block", "i", "idx", "at", "to", F.explode(F.sequence(bin_of(F.col("to")), bin_of(F.col("at") + history_tokens))).alias("_bin"))
    history = (
        candidates.join(starts.select("key", "window", "allowed", bin_of(F.col("window")).alias("_bin")), ["key", "_bin"])
        .where((F.col("window") >= F.col("to")) & (F.col("window") - F.col("at") <= F.col("allowed")))
        .select("key", "block", "i", "idx", "window", F.lit(True).alias("repeated"))
    )
    # What a block's turns are used for, as one row, so that texts stay where they were sorted.
    uses = own.unionByName(history).groupBy("key", "block", "i").agg(F.collect_list(F.struct("window", "repeated", "idx")).alias("uses"))
    uses = uses.groupBy("key", "block").agg(F.map_from_entries(F.collect_list(F.struct("i", "uses"))).alias("uses"))
    used = rows.join(uses, ["key", "block"]).select("key", "role", "text", "n", F.explode(F.element_at("uses", F.col("i"))).alias("use"))
    used = used.select("key", "use.window", "use.idx", "use.repeated", "role", "text", "n")
    first = base.groupBy("key").agg(F.min("block").alias("block"))
    system = rows.where(is_system).select("key", "block", "text", "n").join(first, ["key", "block"]).select("key", "text", "n")
    again = starts.where(F.col("system_n").isNotNull() & (F.col("idx") > 0)).select("key", "window").join(system, "key")
    every = used.unionByName(again.select("key", "window", F.lit(0).cast("long").alias("idx"), F.lit(True).alias("repeated"), F.lit("system").alias("role"), "text", "n"))
    every = every.repartition("key", "window").withColumn("piece", F.concat(F.lit("### "), escape(F.col("role")), F.lit(":\n"), escape(F.col("text")), F.lit("\n</turn>\n")))
    upto = Window.partitionBy("key", "window").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("end", F.sum(F.length("piece")).over(upto)).withColumn("start", F.col("end") - F.length("piece"))
    loss = ~F.col("repeated") & (F.col("role") == "assistant")
    turn = F.struct("idx", "repeated", loss.alias("loss"), "start", (F.col("start") + F.length(escape(F.col("role"))) + 6).alias("text_start"), (F.col("end") - len("\n</turn>\n")).alias("text_end"), "end", "piece")
    grouped = every.groupBy("key", "window").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(turn)).alias("turns"))
    conversation = F.when(F.col("key").startswith("="), F.expr("substring(key, 2)").cast(turns.schema["conv_id"].dataType))
    return grouped.select(
        conversation.alias("conv_id"), "window", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_budget"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"), F.transform("turns", lambda t: t.dropFields("piece")).alias("turns")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from the windows' texts and spans alone."""
    t = F.col("t")
    turns = formatted.select("conv_id", F.col("text"), F.posexplode("turns").alias("pos", "t")).select(
        "conv_id",
        F.when(F.col("pos") == 0, F.length("text")).otherwise(0).alias("chars"),
        t["idx"].alias("idx"),
        t["repeated"].alias("repeated"),
        t["loss"].alias("loss"),
        unescape(F.substring("text", (t["start"] + 5).cast("int"), (t["text_start"] - t["start"] - 6).cast("int"))).alias("role"),
        unescape(F.substring("text", (t["text_start"] + 1).cast("int"), (t["text_end"] - t["text_start"]).cast("int"))).alias("said"),
    )
    own, under_loss = ~F.col("repeated"), F.col("loss")
    grouped = turns.groupBy("conv_id").agg(
        F.count_if(own).alias("n_turns"),
        F.array_sort(F.collect_list(F.when(own, F.struct("idx", "role", "said", "loss")))).alias("_turns"),
        F.sum(F.when(under_loss, F.length("said")).otherwise(0)).cast("long").alias("loss_chars"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["said"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("_turns", lambda x: x["loss"]), lambda x: x["said"]), "")
    return grouped.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), "loss_chars", F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op1_chat_windows(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("x"),
    ).select("conv_id", "x.turn", "x.role", F.lit(PROBE).alias("text"))
    return read_back(windows(turns.unionByName(probe)))
