"""Chat formatting in budgeted windows.

Method: prefix sums of turn tokens.  Turns are priced, and their running sums within a conversation
assign each turn to the span its sum falls in, so spans are turn-aligned and need no sequential
scan.  What a span may hold is the budget less the system turn and the history allowance (its room);
spans are as wide as the room less the longest turn that is at most half the room, so whatever turn
crosses into a span still fits, and a longer turn has a span of its own.  A window is the
conversation's system turn, the last turns of the span before (as far as the history allowance
and the budget reach) and the span itself.  Only assistant turns of the span itself are under the
loss mask; repeated turns are not, so each is a target exactly once.

The sums are taken in blocks of turn numbers and block totals are added afterwards, so a very long
conversation is spread over tasks.  Everything is DataFrame functions.

Defined results: null text is empty, null role is empty; equal turn numbers are ordered by role and
text, repeated rows all stay; a null conversation id is a conversation of its own; a turn that does
not fit beside the system turn has a window for itself and stays whole, the only windows beyond the
budget; an empty table gives no windows; other columns of the table are not read.
Control strings inside texts are escaped by a backslash and restored by :func:`unescape`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turn numbers per block of the prefix sums.
BLOCK = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def estimated_tokens(text: Column) -> Column:
    """Four characters a token, and four tokens of template a turn."""
    return F.ceil(F.char_length(text) / 4) + F.lit(4)


def windows(df: DataFrame, budget: int = 2048, history: int = 256, tokens=estimated_tokens) -> DataFrame:
    """Formatted windows of a table (conv_id, turn, role, text).

    Returns conv_id, span (order within the conversation), n_repeated (turns at the head that an
    earlier window already held), n_new, formatted, and targets: array of (start, length) of the
    loss mask in code points of ``formatted``, in order.
    """
    turns = df.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).alias("block"),
    ).withColumn("tokens", tokens(F.col("text")).cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    local = W.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    turns = turns.withColumn("upto", F.sum("tokens").over(local)).withColumn("nth", F.count(F.lit(1)).over(local))
    firsts = F.min(F.when(F.col("role") == "system", F.struct("turn", "nth", "text", "tokens")))
    blocks = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), firsts.alias("sys"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.min(F.when(F.col("sys").isNotNull(), F.struct("block", F.col("sys.nth").alias("nth"), F.col("sys.text").alias("text"), F.col("sys.tokens").alias("tokens")))).over(whole).alias("system"),
    )
    placed = turns.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0)))
    placed = placed.select(
        "conv_id", "block", "role", "text", "tokens", (F.col("t0") + F.col("upto")).alias("upto"), (F.col("n0") + F.col("nth")).alias("ord"), "system", room.alias("room"),
        F.coalesce((F.col("system.block") == F.col("block")) & (F.col("system.nth") == F.col("nth")), F.lit(False)).alias("is_system"),
    ).withColumn("large", (F.col("tokens") * 2 > F.col("room")).cast("long"))
    # the longest turn that is not large, and how many large ones a block holds, again over block totals
    local = W.partitionBy("conv_id", "block").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("nth_large", F.sum("large").over(local))
    sizes = placed.groupBy("conv_id", "block").agg(F.sum("large").alias("l"), F.max(F.when(F.col("large") == 0, F.col("tokens"))).alias("m"))
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l0"), F.coalesce(F.max("m").over(whole), F.lit(1)).alias("longest"))
    placed = placed.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b", "block")
    width = F.greatest(F.lit(1), F.col("room") - F.col("longest") + 1)
    # a large turn ends the span before it and has one of its own; span is the number of its first turn
    run = F.struct((2 * (F.col("l0") + F.col("nth_large")) - F.col("large")).alias("large"), F.floor((F.col("upto") - 1) / width).alias("part"))
    placed = placed.withColumn("run", run).drop("l0", "nth_large", "large", "longest", "room")
    spans = placed.groupBy("conv_id", "run").agg(
        F.min("ord").alias("span"), F.max("upto").alias("end"), F.sum("tokens").alias("size"), F.max(F.when(F.col("is_system"), 1).otherwise(0)).alias("own"), F.first("system").alias("system"),
    )
    following = W.partitionBy("conv_id").orderBy("span")
    # what the next window has left for history beside the system turn and its own turns
    left = F.lit(budget) - F.lead("size").over(following) - F.when(F.lead("own").over(following) == 1, 0).otherwise(F.coalesce(F.col("system.tokens"), F.lit(0)))
    spans = spans.withColumn("next", F.lead("span").over(following)).withColumn("allowed", F.least(F.lit(history), left))
    links = spans.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "span", "end", "next", "allowed")
    placed = placed.drop("system").join(links, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r"))).drop("c", "r", "run")
    turn = lambda repeated: F.struct(F.lit(repeated).alias("new"), "ord", "role", "text")
    again = F.col("next").isNotNull() & ~F.col("is_system") & (F.col("end") - F.col("upto") + F.col("tokens") <= F.col("allowed"))
    shown = placed.select("conv_id", F.explode(F.filter(F.array(
        F.struct("span", turn(True).alias("turn")), F.struct(F.when(again, F.col("next")).alias("span"), turn(False).alias("turn")),
    ), lambda x: x["span"].isNotNull())).alias("x")).select("conv_id", "x.span", "x.turn")
    heads = spans.where("system is not null and own = 0").select("conv_id", "span", F.struct(F.lit(False).alias("new"), F.lit(0).cast("long").alias("ord"), F.lit("system").alias("role"), F.col("system.text").alias("text")).alias("turn"))
    packed = shown.unionByName(heads).groupBy("conv_id", "span").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    packed = packed.withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["new"].alias("new"), t["role"].alias("role"), F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
    )))
    tail = END + "\n"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    def step(acc, t):
        body_at = acc["at"] + F.char_length(t["head"])
        length = F.char_length(t["body"]).cast("long")
        here = F.array(F.struct(body_at.cast("long").alias("start"), length.alias("length")))
        return F.struct((body_at + length + len(tail)).cast("long").alias("at"), F.when(t["new"] & (t["role"] == "assistant"), F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))
    made = F.struct(
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("turns", zero, step)["spans"].alias("targets"),
    )
    # a generated row, so that later expressions read the window instead of building it again
    return packed.select(
        "conv_id", "span", F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_repeated"), F.size(F.filter("turns", lambda t: t["new"])).alias("n_new"), F.explode(F.array(made)).alias("w"),
    ).select("conv_id", "span", "n_repeated", "n_new", "w.formatted", "w.targets")


def read_back(formatted: Column, n_repeated: Column) -> Column:
    """The new turns of a window as array of (role, text), parsed from its formatted text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    own = F.slice(pieces, n_repeated + 1, F.size(pieces) - 1 - n_repeated)
    def parse(piece):
        cut = F.instr(piece, "\n")
        head = F.substring(piece, F.lit(len(START) + 1), cut - len(START) - 1)
        return F.struct(F.url_decode(head).alias("role"), unescape(F.substring(piece, cut + 1, F.char_length(piece))).alias("text"))
    return F.transform(own, parse)


def masked_text(formatted: Column, targets: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(targets, lambda t: unescape(F.substring(formatted, (t["start"] + 1).cast("int"), t["length"].cast("int")))), "")
