"""Chat formatting: turns become training texts in windows of a token budget, with a loss mask over the assistant's words.

A turn is written as `<|im_start|>role`, a line feed, its text, `<|im_end|>` and a line feed. Inside roles and texts one
backslash is put into every `<`, backslashes, `|`, so that no control string can come from a text; reading back takes it
out again. A role's line feeds become a control string of their own.

Prefix sums of the turns' tokens give every turn its place in its conversation. They are summed in two levels: by
buckets of turn numbers, then over the buckets' totals, so that a conversation of any length is many groups. The places
deal the turns into blocks of a fixed number of tokens, each of which is one row of turn-aligned windows: a window takes
turns as long as they fit into what the system turn and the repeated history leave of the budget. A first turn of role
system opens every window of its conversation; up to `history` tokens of turns before a window are repeated at its
start. What is repeated stays outside the loss mask, so that each assistant text is a target once.

Everything is column expressions; memory is bounded by one block's turns.

Defined results: null roles and texts are empty ones; turns follow each other by turn (nulls first), then role, then
text, and repeated rows are turns of their own; a null conv_id is a conversation; a turn longer than the budget is a
window of its own, whole; a conversation of a system turn alone is one window; further columns are dropped; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import WHITE

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|im_break|>"

#: What counts as a token: a piece of a word, up to three digits, a sign, or a run of blanks.
TOKEN = rf"\p{{L}}{{1,6}}|\p{{N}}{{1,3}}|[^{WHITE}\p{{L}}\p{{N}}]|[{WHITE}]+"
#: Tokens of a turn besides its text.
TURN_TOKENS = 4
#: Turn numbers in a bucket of the prefix sums, and budgets in a block.
BUCKET, BLOCK = 1024, 16

HEAD, OWN, AGAIN = 0, 1, 2


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def escaped(c: Column) -> Column:
    """No `<|` is left, however the text was."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _opening(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))


def _placed(turns: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """Turns with n tokens, s tokens before them, all tokens of the conversation, and whether they are its system turn."""
    keys = ["conv", "none", "bucket"]
    rows = turns.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none"), F.coalesce(F.expr(f"turn div {BUCKET}"), F.lit(-(1 << 63))).alias("bucket"),
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("n", tokens(F.col("text")) + TURN_TOKENS)
    over = W.partitionBy("conv", "none")
    by = over.orderBy("bucket")
    totals = rows.groupBy(keys).agg(F.sum("n").alias("sum")).select(
        *keys, F.coalesce(F.sum("sum").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("sum").over(over).alias("all"), (F.row_number().over(by) == 1).alias("first"),
    )
    within = W.partitionBy(keys).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select("*", F.row_number().over(within).alias("i"), (F.sum("n").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rows = rows.join(totals, keys)
    return rows.select("conv", "none", "role", "text", "n", (F.col("base") + F.col("before")).alias("s"), "all", (F.col("first") & (F.col("i") == 1) & (F.col("role") == "system")).alias("head"))


def windows(turns: DataFrame, budget: int = 2048, history: int = 256, tokens: Callable[[Column], Column] = token_count) -> DataFrame:
    """Windows of turns (conv_id, turn, role, text): conv_id, start (tokens of the conversation before it, by which its
    windows follow each other), text, loss (spans of code points of text), n_turns (its own), n_repeated (turns at its
    start that earlier windows hold), n_tokens (above the budget only where one turn does not fit).
    """
    size = BLOCK * budget
    block = F.col("s") - F.col("s") % size
    again = F.when(F.col("s") >= block + size - history, F.array(F.struct((block + size).alias("block"), F.lit(AGAIN).alias("kind")))).otherwise(F.array().cast("array<struct<block:bigint,kind:int>>"))
    own = F.concat(F.array(F.struct(block.alias("block"), F.lit(OWN).alias("kind"))), again)
    heads = F.transform(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, F.lit(size).cast("long")), lambda b: F.struct(b.alias("block"), F.lit(HEAD).alias("kind")))
    rows = _placed(turns, tokens).select("conv", "none", "all", "n", "s", "role", _opening(F.col("role")).alias("opening"), escaped(F.col("text")).alias("body"), F.explode(F.when(F.col("head"), heads).otherwise(own)).alias("at"))
    turn = F.struct("s", "n", F.col("at.kind").alias("kind"), (F.col("role") == "assistant").alias("target"), "opening", "body")
    blocks = rows.groupBy("conv", "none", F.col("at.block").alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max("all").alias("all"))
    of = lambda kind: F.filter("turns", lambda t: t["kind"] == kind)
    blocks = blocks.select("conv", "none", "all", of(HEAD).alias("head"), of(OWN).alias("own"), of(AGAIN).alias("past"))
    taken = F.coalesce(F.get("head", F.lit(0))["n"], F.lit(0))
    alone = (F.size("own") == 0) & (F.col("all") == taken)
    blocks = blocks.where((F.size("own") > 0) | alone).withColumn("room", F.greatest(F.lit(budget - history) - taken, F.lit(1)))
    blocks = blocks.withColumn("starts", F.when(F.size("own") == 0, F.array(F.lit(0))).otherwise(_starts()))
    return _written(blocks, history)


def _starts() -> Column:
    """The positions in `own` at which windows start: turns are taken as long as they fit into the room."""
    places = F.transform("own", lambda t, i: F.struct(i.alias("i"), t["s"].alias("s"), (t["s"] + t["n"]).alias("e")))
    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(None).cast("long").alias("since"))

    def step(acc: Column, p: Column) -> Column:
        fits = p["e"] - acc["since"] <= F.col("room")
        return F.when(fits, acc).otherwise(F.struct(F.concat(acc["starts"], F.array(p["i"])).alias("starts"), p["s"].alias("since")))

    return F.aggregate(places, none, step)["starts"]


def _written(blocks: DataFrame, history: int) -> DataFrame:
    """The windows of blocks, written out."""
    lo, hi = F.col("lo"), F.coalesce(F.get("starts", F.col("k") + 1), F.size("own"))
    rows = blocks.select("*", F.posexplode("starts").alias("k", "lo"))
    rows = rows.select("conv", "none", "head", "past", "own", F.slice("own", lo + 1, hi - lo).alias("new"), F.coalesce(F.get("own", lo)["s"], F.lit(0)).alias("start"), F.slice("own", F.lit(1), lo).alias("passed"))
    opens = F.size("head") == 0
    opens = opens | (F.col("start") == F.coalesce(F.get("head", F.lit(0))["n"], F.lit(0))) | (F.size("own") == 0)
    past = F.filter(F.concat("past", "passed"), lambda t: t["s"] >= F.col("start") - history)
    rows = rows.select("conv", "none", "start", F.size("new").alias("n_new"), past.alias("again"), opens.alias("opens"), "head", "new")
    rows = rows.select("conv", "none", "start", F.concat("head", "again", "new").alias("turns"), (F.size("again") + F.when(F.col("opens"), 0).otherwise(F.size("head"))).alias("n_repeated"))
    pieces = F.transform("turns", lambda t: F.concat(t["opening"], t["body"], F.lit(f"{END}\n")))
    lengths = F.transform("turns", lambda t, i: F.struct(F.length(t["opening"]).alias("before"), F.length(t["body"]).alias("body"), (t["target"] & (i >= F.col("n_repeated"))).alias("target")))
    spans = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + t["before"]
        span = F.struct(start.alias("start"), (start + t["body"]).alias("end"))
        return F.struct((start + t["body"] + len(END) + 1).alias("at"), F.when(t["target"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return rows.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "start", F.array_join(pieces, "").alias("text"), F.aggregate(lengths, spans, step)["found"].alias("loss"),
        (F.size("turns") - F.col("n_repeated")).alias("n_turns"), "n_repeated", F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("n_tokens"),
    )


def turns_of(text: Column) -> Column:
    """Roles and texts read back from a window's text."""
    pieces = F.slice(F.split(text, START.replace("|", r"\|"), -1), F.lit(2), F.lit(1 << 30))
    role = lambda p: unescaped(F.replace(F.substring_index(p, "\n", 1), F.lit(BREAK), F.lit("\n")))
    body = lambda p: F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 2 - len(END))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescaped(body(p)).alias("text")))


def targets_of(text: Column, loss: Column) -> Column:
    """The texts under a window's loss mask, read back."""
    return F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["end"] - s["start"])))
