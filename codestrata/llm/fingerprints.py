"""Document fingerprints by consistent weighted sampling.

Method: each distinct lower-cased word of a document is a term; its weight is its number of
occurrences times its length, the characters it covers.  A draw of a term takes r, c ~ Gamma(2, 1)
and b ~ U(0, 1) from hashes of the term and the round alone, and

    t = floor(ln(w) / r + b),   ln a = ln c - r * (t - b + 1);

the sample is the (term, t) with the smallest a, and two documents agree in it with the probability
of their generalised Jaccard similarity, sum(min(w, v)) / sum(max(w, v)).

Every term draws in all ``DRAWS`` samples, whatever its weight.  A draw takes one hash: r is read from a
table of equally likely values of its distribution; c needs a fine lower tail, where samples are won,
so the zeros at the end of its bits choose a power of two and four more bits a sixteenth of it.  A draw
is one long, ln a in fixed point above the 32 bits of its sample, so a sample is a plain minimum;
``STEP`` draws of a term are made in one row, few enough that the generated code is compiled.  Words are
counted as numbers, 44 bits of hash above 20 bits of length (a longer word weighs that much).

Everything is DataFrame functions.  Term counts and minima are aggregated where the document's row
lies, so the text moves once (to its neighbour in id order) and the samples not at all.

Defined results: null text is empty; a text without words has the fingerprint of all ``f``, which
agrees with another such text only; equal texts have equal fingerprints; rows that share an id are
told apart by position, and their order among each other is by text hash.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DRAWS, STEP, RANGES = 64, 4, 20_000
_EMPTY = 0xFFFFFFFF
#: ln a lies between -96 and 32, so with 24 bits after the point it takes 31 bits.
_LOWEST, _UNIT = -96.0, float(1 << 24)
#: Bits of a power of two of c, and of r.
_PART, _R = 4, 7
_ZEROS = 24
_LENGTH = 20


def gamma_quantile(u: float) -> float:
    """The value that a Gamma(2, 1) variable stays below with probability u."""
    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        # 1 - (1 + x) exp(-x) loses its digits for a small x, where it is x^2 / 2 - x^3 / 3 + x^4 / 8
        under = mid * mid / 2 - mid**3 / 3 + mid**4 / 8 if mid < 1e-3 else -math.expm1(-mid) - mid * math.exp(-mid)
        low, high = (mid, high) if under < u else (low, mid)
    return (low + high) / 2


def _tables() -> tuple[list[float], list[float]]:
    """ln c by (zeros, sixteenth) and r by its bits, each at the middle of the probability it stands for."""
    part = 1 << _PART
    lnc = [round(math.log(gamma_quantile(2.0 ** -(g + 1) * (1 + (i + 0.5) / part))), 5) for g in range(_ZEROS + 1) for i in range(part)]
    return lnc, [round(gamma_quantile((i + 0.5) / (1 << _R)), 5) for i in range(1 << _R)]


def _constant(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))


def fingerprint(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """One row (keys..., sig) for each row of ``df``: ``sig`` is an array of ``DRAWS`` 32-bit numbers.

    ``words`` is an array<string> column; ``keys`` identify a row.  If ``df`` is partitioned by a
    subset of the keys, no exchange is added.
    """
    number = lambda w: F.xxhash64(w).bitwiseAND(F.lit(-1 << _LENGTH)).bitwiseOR(F.least(F.char_length(w), F.lit((1 << _LENGTH) - 1)).cast("long"))
    terms = df.select(*keys, F.explode_outer(F.transform(F.array_remove(words, ""), number)).alias("term"))
    counted = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    weight = F.coalesce(F.log(F.col("n") * F.col("term").bitwiseAND(F.lit((1 << _LENGTH) - 1))), F.lit(0.0))
    weighed = counted.select(*keys, "term", F.col("term").isNotNull().alias("some"), weight.alias("lnw"))
    at = range(STEP)
    drawn = weighed.select(*keys, "term", "some", "lnw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS // STEP - 1))).alias("part"))
    drawn = drawn.select(*keys, "some", "lnw", "part", *(F.xxhash64("term", F.col("part") * STEP + i).alias(f"p{i}") for i in at))
    lnc_of, r_of = map(_constant, _tables())
    low = lambda x, width: x.bitwiseAND(F.lit((1 << width) - 1))

    def lnc(p: Column) -> Column:
        x = F.shiftrightunsigned(p, 64 - _ZEROS - _PART).bitwiseOR(F.lit(1 << _ZEROS))
        zeros = F.bit_count(F.bitwise_not(x).bitwiseAND(x - 1))  # the bits above them choose nothing here
        return F.get(lnc_of, (zeros * (1 << _PART) + low(F.shiftrightunsigned(p, 32), _PART)).cast("int"))

    drawn = drawn.select(*keys, "some", "lnw", "part", *(x for i in at for x in (
        F.col(f"p{i}"), lnc(F.col(f"p{i}")).alias(f"c{i}"), F.get(r_of, low(F.col(f"p{i}"), _R).cast("int")).alias(f"r{i}"),
        ((low(F.shiftrightunsigned(f"p{i}", _R), 20) + F.lit(0.5)) * F.lit(1.0 / (1 << 20))).alias(f"b{i}"),
    )))
    drawn = drawn.select("*", *(F.floor(F.col("lnw") / F.col(f"r{i}") + F.col(f"b{i}")).alias(f"t{i}") for i in at))

    def packed(i: int) -> Column:
        value = F.col(f"c{i}") - F.col(f"r{i}") * (F.col(f"t{i}") - F.col(f"b{i}") + F.lit(1.0))
        chosen = F.col(f"p{i}").bitwiseXOR(F.shiftleft(f"t{i}", 20)).bitwiseAND(F.lit(_EMPTY - 1))
        fixed = F.floor((value - F.lit(_LOWEST)) * F.lit(_UNIT))
        return F.when(F.col("some"), F.shiftleft(fixed, 32).bitwiseOR(chosen)).otherwise(F.lit(_EMPTY))

    least = drawn.groupBy(*keys, "part").agg(*(F.min(packed(i)).alias(f"s{i}") for i in at))
    parts = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", F.array(*(F.col(f"s{i}").bitwiseAND(F.lit(_EMPTY)) for i in at)).alias("s")))).alias("set"))
    return parts.select(*keys, F.flatten(F.col("set.s")).alias("sig"))


def words_of(text: Column) -> Column:
    """Lower-cased words between white space; none for an empty text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    met = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(met, F.lit(0), lambda s, x: s + x) / F.lit(float(DRAWS))


def _at_most(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are at most ``x``: a binary search by falling powers of two."""
    if not bounds:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one constant
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(bounds)) & (F.get(known, n + s - 1) <= x), n + s).otherwise(n))


def with_neighbours(df: DataFrame, doc_id: str, text: str, least: int = 64) -> DataFrame:
    """(bucket, ghost, row, id, text, next) with the next document's text in descending id order, cyclic.

    Ids are cut at quantiles into ranges of about max(least, sqrt(rows) / 4) rows, whatever their values are;
    an id of many rows has ranges of its own, by text hash.  Each range is one window partition; a copy
    of the next range's first row (ghost) closes it, so nothing crosses ranges.  Null ids come last.
    Ranges number ``RANGES`` at most, which bounds the quantiles and the broadcast of range heads.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = docs.select("id").count()
    ranges = min(RANGES, max(1, n // max(least, math.isqrt(n or 1) // 4)))
    shares = ",".join(repr(i / ranges) for i in range(1, ranges))
    cuts = docs.agg(F.expr(f"percentile_approx(id, array({shares}), {10 * ranges})")).first()[0] or [] if ranges > 1 else []
    times = Counter(cuts)
    bounds = sorted(times.keys() | {v + 1 for v, k in times.items() if k > 1 and v < (1 << 63) - 1})
    hash_ = F.xxhash64("text")
    place = F.coalesce(_at_most(bounds, F.col("id")), F.lit(-1)).cast("long")
    many = {v: k for v, k in times.items() if k > 1}
    sub = F.lit(0).cast("long")
    if many:  # the ranges of an id of many rows, in the order of the hashes
        share = F.element_at(F.map_from_arrays(*(F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (many.keys(), many.values()))), F.col("id"))
        sub = F.coalesce(F.floor((F.shiftright(hash_, 32) + F.lit(1 << 31)) * share / F.lit(float(1 << 32))), F.lit(0)).cast("long")
    # falling ids are rising buckets
    docs = docs.withColumn("bucket", (F.lit(len(bounds)) - place) * F.lit(1 << 24) + sub).withColumn("h", hash_)
    order = [F.col("id").desc_nulls_last(), F.col("h"), F.col("text")]
    heads = docs.groupBy("bucket").agg(F.min(F.struct((-F.col("id")).isNull().alias("none"), (-F.col("id")).alias("minus"), "h")).alias("head"))
    rising = W.partitionBy(F.lit(0)).orderBy("bucket")
    heads = heads.select(F.col("bucket").alias("b"), (-F.col("head.minus")).alias("i"), F.col("head.h").alias("hh"), F.coalesce(F.lag("bucket").over(rising), F.max("bucket").over(W.partitionBy(F.lit(0)))).alias("before"))
    ghosts = docs.join(F.broadcast(heads), (docs["bucket"] == heads["b"]) & docs["id"].eqNullSafe(heads["i"]) & (docs["h"] == heads["hh"])).select("id", "text", "h", F.col("before").alias("bucket"))
    both = docs.withColumn("ghost", F.lit(0)).unionByName(ghosts.withColumn("ghost", F.lit(1)))
    in_range = W.partitionBy("bucket").orderBy("ghost", *order)
    return both.select("bucket", "ghost", F.row_number().over(in_range).alias("row"), "id", "text", F.lead("text").over(in_range).alias("next"))
