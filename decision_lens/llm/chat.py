r"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written as <turn>role<text>text</turn>; inside role and text a backslash becomes \b and < becomes \l, so no text
can close a turn or open one. The budget of a window holds all of its tokens: room for the system turn and for the history is set
aside first. Prefix sums of turn tokens cut a conversation at every multiple of the rest, and a turn belongs to the window in
which its first token falls; if the window would become longer than the rest by its last turn, that turn is a window of its own.
Each window starts with the system turn and the last turns of the window before, up to a number of tokens; these repeats are not
targets again. A system turn that takes more than half of the budget without history stands in its place only. ``loss`` lists the
code point ranges (start, length) of the assistant texts that a window teaches. Tokens of a turn are its words and one for each mark.

Prefix sums are taken in two steps (over blocks of turns, then within a block), so a conversation that holds much of the table
is not ordered in one task; formatting and windows need no more than a window at a time.

Defined cases: a null role or text is empty; rows with a null conversation form one conversation with a null id; null turns
come first; turns of one number are ordered by role and text; repeated rows are turns of their own; a turn longer than the
room is a window of its own, the only kind that can exceed the budget, and stays whole; an empty table gives an empty result; more columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from decision_lens.llm.textkit import quoted

BUDGET, HISTORY, MARKS = 1024, 256, 3
BLOCK = 256
NO_TURN = -(1 << 62)


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with tokens, the tokens before them in their conversation (``at``, different for every turn) and those of the first system turn."""
    text_c, role_c = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (text, role))
    t = rows.select(quoted(conv).alias("conv_id"), F.coalesce(quoted(turn).cast("long"), F.lit(NO_TURN)).alias("turn"),
                    role_c.alias("role"), text_c.alias("text"))
    t = t.withColumn("tokens", F.size(F.array_remove(F.split("text", "\\s+"), "")) + MARKS).withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = t.groupBy("conv_id", "block").agg(F.sum("tokens").alias("sum"), F.min(F.when(F.col("role") == "system", F.struct("turn", "text", "tokens"))).alias("system"))
    before = F.sum("sum").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("sum")
    system = F.min("system").over(Window.partitionBy("conv_id"))["tokens"]
    blocks = blocks.select(F.col("conv_id").alias("c_"), F.col("block").alias("b_"), before.alias("before"), system.alias("system_tokens"))
    t = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("block") == F.col("b_")))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select("conv_id", "turn", "role", "text", "tokens", (F.col("before") + F.sum("tokens").over(inner) - F.col("tokens")).alias("at"), "system_tokens")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss, n_repeat (turns that only repeat), n_tokens (of all its turns)."""
    if not 0 <= history < budget:
        raise ValueError("the history must leave room in the budget")
    leads = 2 * F.col("system_tokens") <= budget - history
    room = budget - history - F.coalesce(F.when(leads, F.col("system_tokens")), F.lit(0))
    piece = F.concat(F.lit("<turn>"), escaped(F.col("role")), F.lit("<text>"), escaped(F.col("text")), F.lit("</turn>"))
    # a turn travels once, as it is written
    t = turns.select("conv_id", "at", "tokens", room.alias("room"), piece.alias("piece"), (F.col("role") == "assistant").alias("target"),
                     F.length(escaped(F.col("text"))).alias("n"))
    # cells of the room; the last turn of a cell may run over its end, and is a window of its own where the cell gets too long by it
    t = t.withColumn("cell", F.floor(F.col("at") / F.col("room"))).withColumn("stop", F.col("at") + F.col("tokens"))
    cell = Window.partitionBy("conv_id", "cell")
    t = t.withColumn("first", F.min("at").over(cell))
    t = t.withColumn("alone", (F.col("at") > F.col("first")) & (F.col("stop") - F.col("first") > F.col("room")))
    end = F.when(F.col("alone"), F.col("stop")).otherwise(F.max(F.when(~F.col("alone"), F.col("stop"))).over(cell))
    t = t.withColumn("end", end).withColumn("window", 2 * F.col("cell") + F.col("alone").cast("int"))
    # the next turn starts where the window ends: it is the one left over in this cell, or the first of another
    then = F.floor(F.col("end") / F.col("room"))
    t = t.withColumn("next", 2 * then + (then == F.col("cell")).cast("int"))
    turn = F.struct("at", "piece", "target", "n", "tokens")
    t = t.withColumn("near", F.col("end") - F.col("at") <= history)
    place = F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("again")),
                    F.when(F.col("near"), F.struct(F.col("next").alias("window"), F.lit(True).alias("again"))))
    spread = t.select("conv_id", turn.alias("turn"), F.explode(F.array_compact(place)).alias("p"))
    system = (turns.where((F.col("role") == "system") & leads).groupBy("conv_id").agg(F.min_by(
        F.struct("at", F.concat(F.lit("<turn>system<text>"), escaped(F.col("text")), F.lit("</turn>")).alias("piece"), "tokens"), "at").alias("system")))
    w = (spread.groupBy("conv_id", F.col("p.window").alias("window")).agg(
        F.sort_array(F.collect_list(F.when(F.col("p.again"), F.col("turn")))).alias("past"),
        F.sort_array(F.collect_list(F.when(~F.col("p.again"), F.col("turn")))).alias("own")).where(F.size("own") > 0))
    w = w.join(system.withColumnRenamed("conv_id", "c_"), F.col("conv_id").eqNullSafe(F.col("c_")), "left")
    # the system turn leads unless it is in the window already
    lead = F.col("system").isNotNull() & (F.col("system.at") < F.col("own")[0]["at"]) & ~F.exists("past", lambda x: x["at"] == F.col("system.at"))
    w = w.withColumn("lead", F.when(lead, F.col("system.piece")).otherwise("")).withColumn("n_lead", lead.cast("int"))
    w = w.withColumn("head", F.concat("lead", F.array_join(F.transform("past", lambda x: x["piece"]), "")))
    body = F.array_join(F.transform("own", lambda x: x["piece"]), "")
    # the text of a turn ends before its closing mark; its place follows from the lengths before it
    walk = F.expr("""aggregate(own, named_struct('at', length(head), 'found', cast(array() AS array<struct<start: int, length: int>>)),
        (s, x) -> named_struct('at', s.at + length(x.piece), 'found', if(x.target, concat(s.found, array(named_struct(
        'start', s.at + length(x.piece) - 7 - x.n, 'length', x.n))), s.found))).found""")
    return w.select("conv_id", "window", F.concat("head", body).alias("formatted"), walk.alias("loss"),
                    (F.col("n_lead") + F.size("past")).alias("n_repeat"),
                    (F.when(lead, F.col("system.tokens")).otherwise(0) + F.aggregate(F.concat("past", "own"), F.lit(0), lambda s, x: s + x["tokens"].cast("int"))).alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns as (role, text), and taught texts, that the windows hold: one row per window, repeats left out."""
    pieces = F.slice(F.split("formatted", "</turn>"), F.col("n_repeat") + 1, F.lit(1 << 30))
    turns = F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.struct(
        unescaped(F.substring_index(F.substring(x, 7, 1 << 30), "<text>", 1)).alias("role"),
        unescaped(F.substring_index(x, "<text>", -1)).alias("text")))
    taught = F.expr("transform(loss, s -> substring(formatted, s.start + 1, s.length))")
    return formatted.select("conv_id", "window", turns.alias("turns"), F.transform(taught, unescaped).alias("taught"),
                            F.length("formatted").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns, digest of its turns and of its taught texts, as read back from the windows."""
    r = read_back(formatted)
    r = r.select("conv_id", F.struct("window", F.size("turns").alias("n"),
                                     F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"),
                                     F.array_join("taught", "").alias("taught"), "chars").alias("w"))
    g = r.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    said, taught = (F.array_join(F.transform("ws", lambda x: x[k]), "") for k in ("said", "taught"))
    return g.select("conv_id", F.aggregate("ws", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_turns"),
                    F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(taught).cast("long").alias("loss_chars"),
                    F.sha2(taught.cast("binary"), 256).alias("loss_sha256"),
                    F.aggregate("ws", F.lit(0).cast("long"), lambda s, x: s + x["chars"]).alias("formatted_chars"))
