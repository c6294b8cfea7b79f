"""Chat formatting in budgeted, turn-aligned windows; DataFrame functions only.

Prefix sums of turn tokens choose the spans: turns whose prefix falls into the same stretch of
``S = (budget - history - system) div 2`` tokens make a span, so that a span with its last turn stays
under 2 S. A turn of over S tokens goes on in pieces of S at most, which are dealt to windows like turns.
Each window repeats the conversation's system turn and the turns that begin within ``history`` tokens
before it, under a code of their own and outside the loss mask; each assistant text is under the mask
once, its pieces each in one window only.

Template: ``<s>`` window ``</s>``; a turn is ``[`` code role ``]`` text, code T for a turn in its first
place, C for its further pieces, R for a repeated one. Inside roles and texts ``~ < [ ]`` are written
``~0 ~1 ~2 ~3``, so no text can hold a control string, and reading undoes it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 256
#: Tokens that a turn has besides its text, and bytes in a token (an estimate that needs no vocabulary).
TURN_TOKENS, TOKEN_BYTES = 8, 4
_ESCAPES = [("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3")]


def escaped(x: Column) -> Column:
    for a, b in _ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescaped(x: Column) -> Column:
    for a, b in reversed(_ESCAPES):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def tokens(text: Column) -> Column:
    """Estimated tokens of a turn."""
    return F.ceil(F.octet_length(text) / TOKEN_BYTES).cast("long") + TURN_TOKENS


def _pieces(text: Column, room: Column) -> Column:
    """A text in pieces of at most ``room`` tokens each; a character may have as many bytes as a token."""
    size = F.when(F.octet_length(text) == F.length(text), TOKEN_BYTES * (room - TURN_TOKENS)).otherwise(room - TURN_TOKENS)
    return F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``(conv_id, window, text, loss)``: formatted windows, and the (start, size) of their masked-in texts.

    Rows go by turn, ties by role and text; repeated rows are turns of their own. Null roles and texts
    are empty; a null conv_id is a conversation like any other. The system turn is the first turn
    if its role is system. Windows keep to ``budget``, but where the system turn, which each repeats
    whole, leaves less than two sixteenths of it: there turns aren't cut.
    """
    least = max(2 * TURN_TOKENS, budget // 16)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("is_system", (F.col("n") == 1) & (F.col("role") == "system"))
    system = F.first(F.when(F.col("is_system"), tokens(F.col("text"))).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("system", system).withColumn("room", F.expr(f"({budget - history} - system) div 2")).withColumn("stretch", F.greatest(F.lit(TURN_TOKENS), F.col("room")))
    cut = (tokens(F.col("text")) > F.col("stretch")) & ~F.col("is_system") & (F.col("room") >= least)
    rows = rows.select("conv_id", "n", "role", "is_system", "stretch", F.posexplode(F.when(cut, _pieces(F.col("text"), F.col("room"))).otherwise(F.array("text"))).alias("piece", "text")).withColumn("t", tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("n", "piece")
    rows = rows.withColumn("at", F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("t"))
    order = Window.partitionBy("conv_id").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    alone = F.col("t") > F.col("stretch")
    rows = rows.withColumn("block", F.sum((alone | F.coalesce(F.lag(alone).over(order), F.lit(False))).cast("long")).over(upto)).withColumn("bin", F.expr("at div stretch"))
    same = F.lag(F.struct("block", "bin")).over(order).eqNullSafe(F.struct("block", "bin"))
    rows = rows.withColumn("head", ~same).withColumn("window", F.sum((~same).cast("long")).over(upto))

    mark = lambda code: F.concat(F.lit("["), code, escaped(F.col("role")), F.lit("]"))
    repeated = F.concat(mark(F.lit("R")), escaped(F.col("text")))
    back = Window.partitionBy("conv_id").orderBy("at").rangeBetween(-history, -1)
    lead = F.concat(F.coalesce(F.first(F.when(F.col("is_system"), F.col("again"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")), F.array_join(F.collect_list(F.when(~F.col("is_system"), F.col("again"))).over(back), ""))
    rows = rows.withColumn("again", repeated).withColumn("lead", F.when(F.col("head"), F.concat(F.lit("<s>"), lead)).otherwise(F.lit("")))
    rows = rows.withColumn("mark", mark(F.when(F.col("piece") == 0, "T").otherwise("C"))).withColumn("body", escaped(F.col("text")))
    inside = Window.partitionBy("conv_id", "window").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length("lead") + F.length("mark") + F.length("body")).over(inside))
    loss = F.when((F.col("role") == "assistant") & (F.length("body") > 0), F.struct((F.col("end") - F.length("body")).alias("start"), F.length("body").cast("long").alias("size")))
    parts = F.array_sort(F.collect_list(F.struct("at", F.concat("lead", "mark", "body").alias("part"), loss.alias("loss"))))
    out = rows.groupBy("conv_id", "window").agg(parts.alias("x"))
    return out.select("conv_id", "window", F.concat(F.array_join(F.col("x.part"), ""), F.lit("</s>")).alias("text"), F.filter(F.col("x.loss"), lambda x: x.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, window, turns, masked, chars)`` from :func:`windows`: turns in their first place as (goes_on, role, text), masked-in texts.

    A turn that ``goes_on`` is a further piece of the conversation's turn before it.
    """
    body = F.expr("substring(text, 4, length(text) - 7)")
    seg = F.filter(F.split(body, "\\["), lambda s: s.startswith("T") | s.startswith("C"))
    role = lambda s: unescaped(F.substring(F.substring_index(s, "]", 1), 2, 2147483647))
    turns = F.transform(seg, lambda s: F.struct(s.startswith("C").alias("goes_on"), role(s).alias("role"), unescaped(F.substring_index(s, "]", -1)).alias("text")))
    masked = F.transform("loss", lambda m: unescaped(F.substring(F.col("text"), (m["start"] + 1).cast("int"), m["size"].cast("int"))))
    return formatted.select("conv_id", "window", turns.alias("turns"), masked.alias("masked"), F.length("text").cast("long").alias("chars"))


def digests(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the windows.

    A digest is over a conversation's whole text in order, so that text meets in one row; it meets
    window by window, not turn by turn.
    """
    got = read_back(windows(conversations, budget, history))
    # each turn opens with the line end of the turn before it; the first one's is cut off, and the last one's added
    turns = F.array_join(F.transform("turns", lambda t: F.when(t["goes_on"], t["text"]).otherwise(F.concat(F.lit("\n"), t["role"], F.lit("\n"), t["text"]))), "")
    first = F.size(F.filter("turns", lambda t: ~t["goes_on"]))
    per = got.select("conv_id", "window", first.cast("long").alias("n"), turns.alias("turns"), F.array_join("masked", "").alias("masked"), "chars")
    x = F.array_sort(F.collect_list(F.struct("window", "turns", "masked")))
    whole = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), x.alias("x"), F.sum("chars").alias("formatted_chars"))
    whole = whole.select("conv_id", "n_turns", F.concat(F.expr("substring(array_join(x.turns, ''), 2)"), F.lit("\n")).alias("turns"), F.array_join("x.masked", "").alias("masked"), "formatted_chars")
    return whole.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")
