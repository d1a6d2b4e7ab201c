"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its share of all words by weight, at most ``most`` times its own words; what it can't
take goes to the others by weight until none is above.  A document is expected ``rate`` times, the target
over the source's words (with a ``weight`` column: in proportion to it, at most ``most``).  The whole part
of that is certain: every document of the source is copied so often.  The fraction is an inclusion
probability p, and documents are ranked by u / (1 - u) over p / (1 - p), u uniform: Pareto order sampling.
The sample's size is fixed in words.  A pass takes documents in rank order while they fit what is left;
the next looks for more among those that fit what the one before left, and the one document that brings
the source nearest to its target is the last.

u is a hash of id and text, so reruns agree on any cluster.  A pass sums words in buckets of u, finds the
bucket where a source's budget ends, and orders the rows of that bucket only, so a source that holds a
third of all rows is spread like any other; what a pass decides is one threshold a source, which every
row compares itself with.  Sources are numbered by a range sort, and joined by broadcast up to
``BROADCAST`` of them, else with a salt.

Defined results: null text has no words and a null source is one source, the last in order; documents
without words take none; rows that repeat an id and a text are taken or left together, and share a u;
ties of u are ordered by the hash; a very long text is one row, counted in whole, and left out where it
does not fit its source's budget (its certain copies stay); an empty table gives an empty one.  All columns
are returned, and one named ``__mix`` is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import cut

#: Passes of a sample, rows of a bucket, and the number of sources up to which they are broadcast.
PASSES, BUCKET, BROADCAST, SALTS = 3, 8192, 100_000, 16


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def digest(key: Column, text: Column, seed: int = 0) -> Column:
    """Hash of an id and a text, from which the uniform draw is taken and ties are broken."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"), 256)


def uniform(hashed: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a hexadecimal hash."""
    return (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def odds(p: Column) -> Column:
    return F.try_divide(p, 1 - p)


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 in the order of ``source`` by code point, null last; no task holds all sources."""
    at = F.monotonically_increasing_id()
    keys = [F.col("source").isNull(), F.col("source")]
    # written once, as the numbers depend on how the rows were dealt
    placed = cut(sources.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", at))
    part = F.shiftright("__at", 33)
    before = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    starts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    placed = placed.withColumn("__part", part).join(starts, "__part")
    return placed.withColumn("rank", F.col("__start") + F.col("__at") - F.shiftleft("__part", 33)).drop("__at", "__part", "__start")


def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """Adds weight and target to (source, source_size): shares of all words by weight, none above ``most`` times its own."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    s = cut(numbered(sources).withColumn("weight", weight).drop("rank"))
    cap = F.col("source_size") * most
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # a source once full stays full, as the level only rises
        over = (F.col("weight") * level > cap) if full >= 0 else F.lit(False)
        kept, rest, n = s.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == full or not rest:
            break
        level, full = (total - (kept or 0)) / rest, n
    return s.withColumn("target", F.least((F.col("weight") * level).cast("double"), cap.cast("double")))


def _with_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with what is known of their source; a source with most of the rows is not one task."""
    s = sources.withColumnRenamed("source", "__of")
    if few:
        return rows.join(F.broadcast(s), F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    dealt = s.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("__digest"), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", salt).join(dealt, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__salt") == F.col("__s"))).drop("__of", "__s", "__salt")


def _ranked(rows: DataFrame, most: float) -> DataFrame:
    """Adds __copies (certain), __q (rank of the Pareto order) and __bucket, which follows the rank."""
    wanted = F.least(F.lit(float(most)), F.col("rate") * F.col("__w"))
    p = wanted - F.floor(wanted)
    q = F.try_divide(odds(uniform(F.col("__digest"))), odds(p))
    # where all documents are equally likely this is u itself
    u = 1 - F.lit(1.0) / (1 + q * F.col("scale"))
    return rows.withColumn("__copies", F.floor(wanted).cast("long")).withColumn("__q", q).withColumn("__bucket", F.floor(u * F.col("buckets")).cast("long"))


def _taken(row_size: Column) -> Column:
    """Whether a row is under one of its source's thresholds."""
    def under(c: Column) -> Column:
        inside = (F.col("__bucket") == c["bucket"]) & (F.struct(F.col("__q").alias("q"), F.col("__digest").alias("digest")) <= F.struct(c["q"].alias("q"), c["digest"].alias("digest")))
        return (row_size <= c["left"]) & ((F.col("__bucket") < c["bucket"]) | F.coalesce(inside & c["q"].isNotNull(), F.lit(False)))
    return F.col("__q").isNotNull() & F.exists("cuts", under)


_CUT = "struct<left:double,bucket:bigint,q:double,digest:string>"


def _pass(rows: DataFrame, sources: DataFrame, few: bool, most: float) -> DataFrame:
    """One more threshold for each source, and what it leaves."""
    def candidates(s: DataFrame) -> DataFrame:
        known = _ranked(_with_source(rows, s, few), most)
        return known.where(F.col("__q").isNotNull() & (F.col("__size") <= F.col("left")) & ~_taken(F.col("__size")))

    sums = candidates(sources).groupBy("__source", "__bucket", "left").agg(F.sum("__size").alias("t"))
    upto = F.sum("t").over(W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).groupBy(F.col("__source").alias("__of")).agg(
        F.min(F.when(F.col("upto") > F.col("left"), F.struct(F.col("__bucket").alias("bucket"), (F.col("upto") - F.col("t")).alias("base")))).alias("end"), F.max("upto").alias("all"),
    )
    at = sources.join(ends, F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of")
    within = W.partitionBy("__source").orderBy("__q", "__digest").rangeBetween(W.unboundedPreceding, W.currentRow)
    inside = candidates(at).where("__bucket = end.bucket").withColumn("upto", F.col("end.base") + F.sum("__size").over(within)).where("upto <= left")
    last = inside.groupBy(F.col("__source").alias("__of")).agg(F.max(F.struct(F.col("__q").alias("q"), F.col("__digest").alias("digest"))).alias("last"), F.max("upto").alias("got"))
    done = at.join(last, F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of")
    got = F.when(F.col("end").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.coalesce("got", "end.base"))
    made = F.struct("left", F.coalesce("end.bucket", F.lit((1 << 63) - 1)).alias("bucket"), F.col("last.q").alias("q"), F.col("last.digest").alias("digest")).cast(_CUT)
    return cut(done.withColumn("cuts", F.concat("cuts", F.array(made))).withColumn("left", F.col("left") - got).drop("end", "all", "last", "got"))


def _rates(rows: DataFrame, sources: DataFrame, few: bool, most: float) -> DataFrame:
    """Expected copies of a document of weight 1, so that a source's documents, none above ``most``, sum to its target."""
    s, full = cut(sources.withColumn("rate", F.lit(0.0))), -1
    while True:
        over = F.col("rate") * F.col("__w") >= most
        per = _with_source(rows, s, few).groupBy(F.col("__source").alias("__of")).agg(
            F.sum(F.when(over, F.col("__size"))).alias("held"), F.sum(F.when(~over, F.col("__size") * F.col("__w"))).alias("free"), F.count_if(over).alias("full"),
        )
        rate = F.coalesce(F.try_divide(F.col("target") - most * F.coalesce("held", F.lit(0)), F.col("free")), F.col("rate"))
        s = cut(s.drop("full").join(per, F.col("source").eqNullSafe(F.col("__of")), "left").withColumn("rate", rate).drop("__of", "held", "free"))
        n = s.agg(F.sum("full")).first()[0] or 0
        if n == full:
            return s.drop("full")
        full = n


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, weight: str | None = None, seed: int = 0) -> DataFrame:
    """All rows of (doc_id, text, source, ...) with ``__mix``: struct(size, source_size, target, copies), copies how often the mix takes the row."""
    rows = docs.select(
        *[c for c in docs.columns if c != "__mix"], F.col("source").alias("__source"), count_words(F.col("text")).alias("__size"), digest(F.col("doc_id"), F.col("text"), seed).alias("__digest"),
        (F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)).alias("__w"),
    )
    slim = cut(rows.select("__source", "__size", "__digest", "__w"))
    sizes = slim.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"), F.count("*").alias("n"))
    s = targets(sizes, weights, most)
    few = s.count() <= BROADCAST
    s = _rates(slim, s, few, most) if weight else s.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    fraction = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("rate") - F.floor("rate")))
    s = s.withColumn("scale", odds(fraction)).withColumn("buckets", F.ceil(F.col("n") / BUCKET)).withColumn("cuts", F.array().cast(f"array<{_CUT}>"))
    if weight:
        certain = _ranked(_with_source(slim, s, few), most).groupBy(F.col("__source").alias("__of")).agg(F.sum(F.col("__copies") * F.col("__size")).alias("sure"))
        s = s.join(certain, F.col("source").eqNullSafe(F.col("__of")), "left").withColumn("left", F.col("target") - F.coalesce("sure", F.lit(0))).drop("__of", "sure")
    else:
        s = s.withColumn("left", F.col("target") - F.floor("rate") * F.col("source_size"))
    for _ in range(PASSES):
        s = _pass(slim, s, few, most)
    # the one that comes nearest: rows that repeat count together
    open_ = _ranked(_with_source(slim, s, few), most).where(F.col("__q").isNotNull() & ~_taken(F.col("__size")) & (F.col("__size") > 0) & (F.col("__size") < 2 * F.col("left")))
    units = open_.groupBy("__source", "left", "__q", "__digest").agg(F.sum("__size").alias("unit"))
    off = F.abs(F.col("unit") - F.col("left"))
    nearest = units.where(off < F.col("left")).groupBy(F.col("__source").alias("__of")).agg(F.min(F.struct(off.alias("off"), F.col("__q").alias("q"), F.col("__digest").alias("digest")))["digest"].alias("nearest"))
    s = cut(s.join(nearest, F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of").select("source", "source_size", "target", "rate", "scale", "buckets", "cuts", "nearest"))
    state = s.select("source", F.struct("source_size", "target").alias("__facts"), F.struct("rate", "scale", "buckets", "cuts", "nearest").alias("__state"))
    out = _with_source(rows, state, few)
    # the ranking reads plain names, so it is done beside the caller's columns, packed into one
    packed = out.select(F.struct(*[c for c in docs.columns if c != "__mix"]).alias("__row"), "__size", "__digest", "__w", "__facts", "__state.*")
    chosen = _ranked(packed, most).withColumn("__chosen", F.coalesce(_taken(F.col("__size")) | (F.col("__digest") == F.col("nearest")), F.lit(False)))
    result = F.struct(F.col("__size").alias("size"), "__facts.source_size", "__facts.target", (F.col("__copies") + F.col("__chosen").cast("long")).alias("copies"))
    return chosen.select("__row.*", result.alias("__mix"))


def expand(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of :func:`mix` as often as it is taken."""
    return mixed.where("__mix.copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix.copies")))).drop("__copy", "__mix")


def query_sql(weights: Sequence[int] = (1, 2, 3), most: int = 3) -> str:
    """The same mix in DuckDB SQL: targets by the sorted points where sources are full, passes by window sums."""
    n = len(weights)
    passes, taken = [], "false"
    for k in range(PASSES):
        passes.append(f"""
, c{k} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, digest) AS upto FROM p{k} WHERE q IS NOT NULL AND NOT {taken} AND size <= left_{k})
, g{k} AS (SELECT source, sum(size) AS got FROM c{k} WHERE upto <= left_{k} GROUP BY source)
, p{k + 1} AS (SELECT p.*, c.digest IS NOT NULL AS t{k}, p.left_{k} - coalesce(g.got, 0) AS left_{k + 1}
  FROM p{k} p LEFT JOIN g{k} g ON p.source IS NOT DISTINCT FROM g.source
  LEFT JOIN (SELECT DISTINCT source, digest FROM c{k} WHERE upto <= left_{k}) c ON p.source IS NOT DISTINCT FROM c.source AND p.digest = c.digest)""")
        taken = f"(t{k}{'' if taken == 'false' else ' OR ' + taken})"
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, sha256('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([{', '.join(map(str, weights))}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} + 1)::INT] AS weight FROM s
), b AS (
  SELECT *, {most} * source_size AS cap, {most} * source_size / weight AS full_at FROM w
), o AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(weight) OVER (ORDER BY full_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lvl FROM b
), l AS (
  SELECT coalesce(arg_min(lvl, k), 0) AS lvl FROM (SELECT lvl, full_at, row_number() OVER (ORDER BY full_at, source) AS k FROM o) WHERE lvl <= full_at
), t AS (
  SELECT source, source_size, least(weight * l.lvl, cap::DOUBLE)::DOUBLE AS target FROM b, l
), r AS (
  SELECT *, coalesce(target / nullif(source_size, 0), 0) AS rate FROM t
), p0 AS (
  SELECT d.*, source_size, target, floor(rate)::BIGINT AS copies, target - floor(rate) * source_size AS left_0,
    CASE WHEN rate > floor(rate) THEN ((('0x' || substr(digest, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 / (1 - (('0x' || substr(digest, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496))
      / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS q
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
){''.join(passes)}
, u AS (
  SELECT source, digest, q, any_value(left_{PASSES}) AS room, sum(size) AS unit FROM p{PASSES} WHERE q IS NOT NULL AND NOT {taken} AND size > 0 AND size < 2 * left_{PASSES} GROUP BY source, digest, q
), z AS (
  SELECT source, digest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(unit - room), q, digest) AS k FROM u WHERE abs(unit - room) < room) WHERE k = 1
)
SELECT p.doc_id, p.size, p.source_size, p.target, ((p.copies + CASE WHEN {taken} OR z.digest IS NOT NULL THEN 1 ELSE 0 END) * p.size)::BIGINT AS taken
FROM p{PASSES} p LEFT JOIN z ON p.source IS NOT DISTINCT FROM z.source AND p.digest = z.digest
"""
