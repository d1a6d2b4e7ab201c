"""Conversation structure repair by weighted finite-state composition.

A conversation is an acceptor of its rows.  The edit transducer keeps a row (0), gives it another role (2),
deletes it (3) or inserts an empty turn (2); a kept or changed row that is truncated costs 1 more, and blank
and repeated rows can only be deleted.  The grammar accepts the role initials ``(s?(ua)+)?``.  Their
composition is never built: arcs are made for the pairs of grammar state and symbol that are reached.

Weights are pairs of cost and label string, compared in this order.  Costs to go are found against the
rows' order; as the strings of two paths that leave one state are compared label by label, the least string
is then read forwards: at each state the least label whose arc stays on a cheapest path.

Rows are range-sorted by conversation and turn and cut into pieces of ``PIECE`` rows.  A conversation of one
piece is solved at once.  For a longer one a piece gives a 4x4 matrix over (min, +), the products of those
after it give its costs to go, and then the map from its first state to its last gives where it starts; both
are scans in two levels, pieces within a partition and partitions within a conversation.  So one conversation that
holds a third of all rows is many pieces.  Repeats are found by an equality join with the first turn of each
(conversation, role, text), and equal rows of one turn are counted before any of it.

Defined results: null role and text are one space; a null conversation id is one conversation; rows of null
turn come first; rows of one turn are ordered by role and a hash of the text, equal ones are copies of the
first; an empty conversation needs no edits; an empty table gives an empty result; very long texts are
hashed in whole and not copied into the pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from codestrata.llm.common import cut

PIECE = 1024
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
TRUNCATED = 1
#: The grammar: states 0 (nothing yet), 1 (system), 2 (user), 3 (assistant); the last of a whole conversation is 0 or 3.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL, STATES, FAR = (0, 3), range(4), 1 << 40
#: What may be inserted or given as a role, by state.
ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}


NUMBERS = ArrayType(LongType())
_EDIT = StructType().add("before", StringType()).add("label", StringType()).add("role", StringType())
WALKED = StructType().add("audit", StringType()).add("cost", LongType()).add("edits", ArrayType(_EDIT)).add("tail", StringType()).add("illegal", LongType()).add("first", StringType()).add("last", StringType())


@lru_cache(maxsize=None)
def inserting(state: int) -> tuple[int, int]:
    """Cost and next state of an inserted turn."""
    return INSERT[1], STEPS[state, ROLE[state][0]]


@lru_cache(maxsize=None)
def consuming(state: int, symbol: str) -> tuple[tuple[str, int, int], ...]:
    """The composed arcs (label, cost, next state) that read a symbol, an initial and a fault, least label first."""
    initial, fault = symbol
    out = [(*DELETE, state)]
    if fault not in "bd":
        late = TRUNCATED if fault == "t" else 0
        if (state, initial) in STEPS:
            out.append((KEEP[0], KEEP[1] + late, STEPS[state, initial]))
        out.append((REROLE[0], REROLE[1] + late, STEPS[state, ROLE[state][0]]))
    return tuple(out)


def _with_inserts(cost: list[int]) -> list[int]:
    """The cheapest cost to go where turns may first be inserted; after two of them states repeat."""
    for _ in range(2):
        cost = [min(cost[s], inserting(s)[0] + cost[inserting(s)[1]]) for s in STATES]
    return cost


END = _with_inserts([0 if s in FINAL else FAR for s in STATES])


def costs_to_go(tape: list[str], end: list[int]) -> list[list[int]]:
    """The cost to go of each state before each symbol and after the last."""
    out = [list(end)]
    for symbol in reversed(tape):
        after = out[-1]
        out.append(_with_inserts([min(c + after[n] for _, c, n in consuming(s, symbol)) for s in STATES]))
    return out[::-1]


def matrix(tape: list[str]) -> list[int]:
    """Cheapest costs from each state to each state over a piece, row by row."""
    columns = [costs_to_go(tape, [0 if s == e else FAR for s in STATES])[0] for e in STATES]
    return [min(columns[e][s], FAR) for s in STATES for e in STATES]


def walk(tape: list[str], go: list[list[int]], state: int, last: bool) -> tuple[list[tuple[str, str, str]], str, int, int]:
    """The least cheapest path: (roles inserted before, label, new role) of each symbol, roles inserted at the end, cost, last state."""
    steps, spent = [], 0
    for i, symbol in enumerate(tape):
        before = ""
        while True:
            here = go[i][state]
            label, cost, following = next((a for a in consuming(state, symbol) if a[0] == DELETE[0] and a[1] + go[i + 1][a[2]] == here), (None, 0, 0))
            if label is None and inserting(state)[0] + go[i][inserting(state)[1]] == here:
                before += ROLE[state][0]
                spent, state = spent + INSERT[1], inserting(state)[1]
                continue
            if label is None:
                label, cost, following = next(a for a in consuming(state, symbol) if a[1] + go[i + 1][a[2]] == here)
            break
        steps.append((before, label, ROLE[state] if label == REROLE[0] else ""))
        spent, state = spent + cost, following
    tail = ""
    while last and state not in FINAL:
        tail += ROLE[state][0]
        spent, state = spent + INSERT[1], inserting(state)[1]
    return steps, tail, spent, state


def _tape(codes, copies) -> list[str]:
    """The symbols of a piece: a row's copies after the first are repeats, or blank like it."""
    return [x for code, n in zip(codes, copies, strict=True) for x in [code] + [code[0] + ("b" if code[1] == "b" else "d")] * (int(n) - 1)]


@F.pandas_udf(NUMBERS)
def _matrix(codes: pd.Series, copies: pd.Series) -> pd.Series:
    return pd.Series([matrix(_tape(c, n)) for c, n in zip(codes, copies, strict=True)], dtype=object)


@F.pandas_udf(NUMBERS)
def _moves(codes: pd.Series, copies: pd.Series, end: pd.Series) -> pd.Series:
    def moves(c, n, e) -> list[int]:
        tape = _tape(c, n)
        go = costs_to_go(tape, [int(x) for x in e])
        return [walk(tape, go, s, False)[3] if go[0][s] < FAR else s for s in STATES]
    return pd.Series([moves(*x) for x in zip(codes, copies, end, strict=True)], dtype=object)


@F.pandas_udf(WALKED)
def _walk(codes: pd.Series, copies: pd.Series, end: pd.Series, start: pd.Series, closing: pd.Series) -> pd.DataFrame:
    out = []
    for c, n, e, s, last in zip(codes, copies, end, start, closing, strict=True):
        tape = _tape(c, n)
        steps, tail, spent, _ = walk(tape, costs_to_go(tape, [int(x) for x in e]), int(s), bool(last))
        audit = "".join(INSERT[0] * len(before) + label for before, label, _ in steps) + INSERT[0] * len(tail)
        firsts = [0]
        for k in n:
            firsts.append(firsts[-1] + int(k))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(tape, tape[1:], strict=False))
        # copies are deleted, and no turn is inserted before a deleted one, so a row's edit is its first copy's
        out.append((audit, spent, [dict(zip(("before", "label", "role"), steps[i], strict=True)) for i in firsts[:-1]], tail, illegal, tape[0][0], tape[-1][0]))
    return pd.DataFrame(out, columns=["audit", "cost", "edits", "tail", "illegal", "first", "last"])


def _scan(pieces: DataFrame, value: str, seed: list[int], total: Callable, step: Callable, backwards: bool) -> DataFrame:
    """(conv_id, piece, carried) of what comes before each piece (after it, backwards): pieces within a part, parts within a conversation."""
    kind = dict(pieces.dtypes)["conv_id"]

    def totals(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("piece")
        return pd.DataFrame([(g["conv_id"].iloc[0], g["part"].iloc[0], reduce(total, (list(map(int, v)) for v in g[value])))], columns=["conv_id", "part", "value"])

    def carry(g: pd.DataFrame, order: str, of: str, first: list[int]) -> list[list[int]]:
        g, now, out = g.sort_values(order, ascending=not backwards), first, []
        for v in g[of]:
            out.append(now)
            now = step(list(map(int, v)), now)
        return out

    def parts(g: pd.DataFrame) -> pd.DataFrame:
        order = g["part"].sort_values(ascending=not backwards)
        return pd.DataFrame({"conv_id": g["conv_id"].iloc[0], "part": order.to_numpy(), "from": carry(g, "part", "value", seed)})

    def within(g: pd.DataFrame) -> pd.DataFrame:
        order = g["piece"].sort_values(ascending=not backwards)
        return pd.DataFrame({"conv_id": g["conv_id"].iloc[0], "piece": order.to_numpy(), "carried": carry(g, "piece", value, list(map(int, g["from"].iloc[0])))})

    known = pieces.select("conv_id", "part", "piece", value)
    of_parts = known.groupBy("conv_id", "part").applyInPandas(totals, f"conv_id {kind}, part long, value array<long>").groupBy("conv_id").applyInPandas(parts, f"conv_id {kind}, part long, from array<long>")
    o = of_parts.select(F.col("conv_id").alias("__c"), F.col("part").alias("__p"), "from")
    both = known.join(o, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p"))).drop("__c", "__p")
    return both.groupBy("conv_id", "part").applyInPandas(within, f"conv_id {kind}, piece long, carried array<long>")


def _times(a: list[int], b: list[int]) -> list[int]:
    return [min(FAR, min(a[4 * s + k] + b[4 * k + e] for k in STATES)) for s in STATES for e in STATES]


def _before(m: list[int], end: list[int]) -> list[int]:
    return [min(FAR, min(m[4 * s + e] + end[e] for e in STATES)) for s in STATES]


def rows_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, hash, copies, fault) of distinct rows: fault b(lank), d(uplicate), t(runcated) or a dot."""
    text = F.coalesce("text", F.lit(" "))
    said = F.rtrim(text, F.lit(WHITE))
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash"), (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("open"))
    d = own.groupBy("conv_id", "turn", "role", "hash", "blank", "open").agg(F.count("*").alias("copies"))
    # the join has the turn in its key, so a text that one conversation says in every turn is no hot key
    firsts = d.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h")).agg(F.min(F.struct("turn")).alias("t"))
    is_first = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")) & F.col("turn").eqNullSafe(F.col("t.turn"))
    j = d.join(firsts, is_first, "left")
    fault = F.when(F.col("blank"), "b").when(F.col("r").isNull(), "d").when(F.col("open"), "t").otherwise(".")
    return j.select("conv_id", "turn", "role", "hash", "copies", fault.alias("fault"))


def _sorted(rows: DataFrame) -> DataFrame:
    """Adds ``at``, a number in the order of conversation, turn, role and text; written once, as it depends on how rows were dealt."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]
    return cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))


def edits(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cheapest repair of (conv_id, turn, role, text).

    Returns the distinct rows with their place ``at``, copies and fault; the pieces (conv_id, piece, closing, audit,
    cost, tail, illegal); and for each distinct row (conv_id, at, before, label, new_role): the initials of the roles
    to insert before it, K, R or D, and the role that R gives.
    """
    rows = _sorted(rows_of(turns))
    initial = F.substring("role", 1, 1)
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("?"), F.col("fault"))
    item = F.struct("at", code.alias("code"), "copies")
    pieces = rows.groupBy("conv_id", F.shiftright("at", 33).alias("part"), F.floor(F.col("at") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    of = W.partitionBy("conv_id")  # one row for each PIECE rows of a conversation
    pieces = cut(pieces.withColumn("n", F.count("*").over(of)).withColumn("closing", F.col("piece") == F.max("piece").over(of)))
    codes, copies = F.col("items.code"), F.col("items.copies")
    end = F.array(*map(F.lit, END)).cast("array<long>")
    short = pieces.where("n = 1").withColumn("end", end).withColumn("start", F.lit(0).cast("long"))
    long = cut(pieces.where("n > 1").withColumn("m", _matrix(codes, copies)))

    def with_carried(df: DataFrame, carried: DataFrame, into: str, value: Column) -> DataFrame:
        c = carried.select(F.col("conv_id").alias("__c"), F.col("piece").alias("__p"), value.alias(into))
        return df.join(c, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("piece") == F.col("__p"))).drop("__c", "__p")

    long = with_carried(long, _scan(long, "m", END, _times, _before, True), "end", F.col("carried"))
    long = cut(long.withColumn("f", _moves(codes, copies, F.col("end"))))
    start = _scan(long, "f", [0], lambda f, g: [g[x] for x in f], lambda f, s: [f[s[0]]], False)
    long = with_carried(long, start, "start", F.get("carried", F.lit(0)))
    walked = short.unionByName(long.drop("m", "f")).withColumn("w", _walk(codes, copies, F.col("end"), F.col("start"), F.col("closing"))).select("conv_id", "piece", "closing", "items", "w.*")
    walked = cut(walked)
    inside = F.lag("last").over(of.orderBy("piece"))
    between = F.when(inside.isNotNull() & ~F.concat(inside, F.col("first")).isin("su", "ua", "au"), 1).otherwise(0)
    told = walked.select("conv_id", "piece", "closing", "audit", "cost", "tail", (F.col("illegal") + between).alias("illegal"))
    each = walked.select("conv_id", F.explode(F.arrays_zip(F.col("items.at").alias("at"), F.col("edits").alias("edit"))).alias("x"))
    return rows, told, each.select("conv_id", "x.at", "x.edit.before", "x.edit.label", F.col("x.edit.role").alias("new_role"))


def _line(initials: Column) -> Column:
    return F.transform(F.regexp_extract_all(initials, F.lit("[ua]"), F.lit(0)), lambda i: F.when(i == "u", "user:").otherwise("assistant:"))


def repaired_lines(turns: DataFrame, rows: DataFrame, pieces: DataFrame, each: DataFrame) -> DataFrame:
    """(conv_id, at, lines): the repaired conversation in order of ``at``, each line ``role:text``."""
    same = ["conv_id", "turn", "role", "hash"]
    text = F.coalesce("text", F.lit(" "))
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash"), text.alias("text")).dropDuplicates(same)
    kept = each.where("label <> 'D'").join(rows.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("hash").alias("h"), F.col("at").alias("a")), F.col("at") == F.col("a"))
    kept = kept.select("c", "t", "r", "h", "at", "before", "new_role").join(said, reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip("ctrh", same, strict=True))))
    line = F.array(F.concat(F.when(F.col("new_role") != "", F.col("new_role")).otherwise(F.col("role")), F.lit(":"), "text"))
    own = kept.select("conv_id", "at", F.when(F.col("before") != "", F.concat(_line(F.col("before")), line)).otherwise(line).alias("lines"))
    return own.unionByName(pieces.where("tail <> ''").select("conv_id", F.lit((1 << 63) - 1).alias("at"), _line(F.col("tail")).alias("lines")))


def audit(turns: DataFrame) -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and ``repaired`` text.

    The audit and the repaired text of a conversation are one row each, as digests need them whole.
    """
    rows, pieces, each = edits(turns)
    again = F.when(F.col("fault") == "b", 0).when(F.col("fault") == "d", F.col("copies")).otherwise(F.col("copies") - 1)
    most, least = F.max("turn").cast("decimal(38,0)"), F.min("turn").cast("decimal(38,0)")
    faults = rows.groupBy("conv_id").agg(
        F.sum(F.when(F.col("fault") == "b", F.col("copies")).otherwise(0)).alias("blank"), F.sum(again).alias("duplicate"), F.sum(F.when(F.col("fault") == "t", 1).otherwise(0)).cast("long").alias("truncated"),
        (most - least + 1).alias("width"),
    )
    numbers = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.count("*").alias("turns"))
    in_order = lambda value, by: F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda x: x[value])
    whole = pieces.groupBy("conv_id").agg(F.array_join(in_order("audit", "piece"), "").alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    text = repaired_lines(turns, rows, pieces, each).groupBy("conv_id").agg(F.array_join(F.flatten(in_order("lines", "at")), "\n").alias("repaired"))
    for other in (numbers, whole, text):
        o = other.withColumnRenamed("conv_id", "__c")
        faults = faults.join(o, F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    gaps = F.coalesce(F.col("width") - F.col("turns"), F.lit(0)).cast("long")
    return faults.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired", F.lit("")).alias("repaired"))
