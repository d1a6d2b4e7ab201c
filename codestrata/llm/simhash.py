"""SimHash near-duplicate groups.

Method: deletion-variant signatures.  A 64-bit fingerprint is cut into two 32-bit segments; two
fingerprints that differ in at most three bits differ in at most one bit of one of them.  Each
distinct fingerprint is indexed under every one-wildcard variant of both segments (64 keys), keys
that are shared are found by equality, and candidates are verified on all 64 bits.

A key shared by more than ``PAIRS`` distinct fingerprints is not paired up.  Up to ``CROWD`` of them are
one bounded group, searched from member to member: each takes the members not yet reached that it
links to, so every member is reached once and at most one edge a member comes out.  Beyond that,
members are linked through balls, again by equality: members that agree on the key (at most one bit apart in
the segment) and are within one bit of a common centre in the other segment are at most three bits
apart, and every pair with one difference here and two there, or none and two, has such a centre.
Pairs with equal segments and three differences in the other one share a one-wildcard variant plus
a centre of the rest.  So the work on a crowded key is linear in its members and no link is lost.

A scheme says what is hashed.  :data:`NARROW` is one 64-bit fingerprint of three-word shingles, linked at
three bits.  :data:`WIDE` links texts whose five-word shingles are similar (Jaccard) by 0.8 or more.
Candidates come from a fingerprint of 256 bits of two-word shingles, of which an edited word touches few.
It is cut into eight segments; a wildcard covers four neighbouring bits, so that a segment with one
differing bit, or with several in one wildcard, agrees, and there are 64 keys again.  Candidates are compared on a
second fingerprint of 512 bits of five-word shingles, on which a similarity of 0.8 is 77 differing bits in the
mean, with a deviation of 8.  Up to ``sure`` bits, four deviations below, are a link; up to ``bits``, more than two
above, are verified by the exact similarity of the two sets of shingles; more are none.  On a crowded
key the sure links are followed first, and the groups that they make are then joined by their nearest
members that are not sure (Boruvka's steps, three edges a group and step), which are verified as well.
Nearest members may all fail while farther ones are links: :func:`wide_classes` then verifies the candidates
that still lie between different classes, nearest first and more of them in each round, until none is left.
A pair of several keys is listed at the first of them only.  Exact sets travel by families of candidates: a set goes once to
each block of its family that has a pair to verify, not once for each pair.  Members of crowded keys are one
row each while their lanes (once) and labels (once in a round) are joined, not one for each of their keys.

Defined results: null text counts as empty and has fingerprint zero; a document of fewer words than a
shingle has one shingle; a row with null id keeps its fingerprint and forms its own component (null).
Rows may share an id: classes are formed by fingerprints and kept rows are told apart by id and text.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut, release_tokens, small_batches
from codestrata.llm.graph import components

#: Distinct fingerprints of a key up to which its pairs are verified one by one.
PAIRS = 16
#: Distinct fingerprints that a task turns into keys.
SPREAD = 16_000
#: Distinct fingerprints of a key that one task searches (8 bytes each).
CROWD = 20_000
#: Members of a key whose pairs between classes one task lists (two million pairs at most).
BETWEEN = 2_000
#: Shingles of the sets that a task verifies (8 bytes each), but for a single text that has more.
SETS = 1 << 19
#: Pairs of a family that are verified together, about.
VERIFIED = 8_192
BITS = 3
_LOW = 0xFFFFFFFF


def simhash(text: str, width: int = 3) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # a byte can count 255 rows
        ones += np.unpackbits(hashes[at : at + 255].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint8)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Adds the fingerprint of each whole text as a long."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_tokens()
        for batch in batches:
            yield pd.Series([simhash(t) for t in batch.fillna("")], dtype="int64")

    return small_batches(df).withColumn(into, fp(F.col(text)))


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * s).bitwiseAND(F.lit(_LOW))


def _keys(fp: Column) -> Column:
    """The 64 one-wildcard keys: segment and wildcard in the upper half, the segment without that bit in the lower."""
    return F.array(*(F.lit((s * 32 + p) << 32).bitwiseOR(_segment(fp, s).bitwiseAND(F.lit(_LOW ^ (1 << p)))) for s in (0, 1) for p in range(32)))


def _balls(value: Column) -> Column:
    """Centres within one bit of a 32-bit value."""
    return F.transform(F.array(*(F.lit(x) for x in (0, *(1 << p for p in range(32))))), lambda x: value.bitwiseXOR(x))


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what pairs at most ``BITS`` apart connect, one at most for each fingerprint."""
    rest, edges = fps.astype("<i8").view("<u8"), []
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= BITS
            if near.any():
                hit = rest[near]
                edges += [(y, x) for y in hit.tolist()]
                stack += list(hit)
                rest = rest[~near]
    signed = lambda v: int(v) - (1 << 64) if int(v) >> 63 else int(v)
    return [(signed(x), signed(y)) for x, y in edges]


def links(distinct: DataFrame, crowd: int = CROWD, pairs_up_to: int = PAIRS) -> DataFrame:
    """Edges (x, y) between fingerprints of ``distinct`` (column fp) at most three bits apart.

    Not every such pair is an edge, but edges join the same fingerprints as all pairs would.
    """
    # 64 keys each: tasks of about SPREAD fingerprints keep the count of a task's keys small
    spread = distinct.repartition(max(1, -(-distinct.count() // SPREAD)))
    keyed = spread.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).where("n > 1"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= BITS
    twos = shared.where("n = 2").select("x", "y").where(near)
    more = cut(keyed.join(shared.where("n > 2").select("key", "n"), "key"))
    few = more.where(F.col("n") <= pairs_up_to).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("x")).join(few.select("key", F.col("fp").alias("y")), "key").where("x < y").where(near).select("x", "y")
    grouped = more.where((F.col("n") > pairs_up_to) & (F.col("n") <= crowd)).select("key", "fp")
    searched = grouped.groupBy("key").applyInPandas(lambda g: pd.DataFrame(spanning_links(g["fp"].to_numpy()), columns=["x", "y"], dtype="int64"), "x long, y long")
    crowded = more.where(F.col("n") > crowd).select("key", "fp")
    wild = F.shiftright("key", 32)
    other = F.when(wild < 32, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    one_side = crowded.select("key", F.explode(_balls(other)).alias("centre"), "fp")
    own = F.when(wild < 32, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1))
    equal = crowded.select((wild >= 32).alias("upper"), own.alias("own"), other.alias("other"), "fp").distinct()
    alike = equal.groupBy("upper", "own").count().where("count > 1").drop("count")
    wild_other = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(_LOW ^ (1 << p)).alias("mask")) for p in range(32)))
    wide = equal.join(alike, ["upper", "own"]).select("upper", "own", "fp", "other", F.explode(wild_other).alias("v"))
    # a flip of the wildcard bit would leave the ball, so that bit is masked out of the centres too
    rest = F.transform(_balls(F.col("other")), lambda c: c.bitwiseAND(F.col("v.mask")))
    wide = wide.select("upper", "own", F.col("v.p").alias("p"), F.explode(F.array_distinct(rest)).alias("centre"), "fp")
    stars = [_stars(one_side, ["key", "centre"]), _stars(wide, ["upper", "own", "p", "centre"])]
    return twos.unionByName(pairs).unionByName(searched).unionByName(stars[0]).unionByName(stars[1]).distinct()


def _stars(members: DataFrame, keys: list[str]) -> DataFrame:
    """An edge from each member to the smallest of its ball."""
    low = members.groupBy(*keys).agg(F.min("fp").alias("y"), F.count("*").alias("n")).where("n > 1").drop("n")
    return members.join(low, keys).where("fp != y").select(F.col("fp").alias("x"), "y").distinct()


@dataclass(frozen=True)
class Wide:
    """Fingerprints of ``lanes`` x 64 bits over ``words``-word shingles, found by an index over ``index_words``.

    Up to ``sure`` differing bits are a link, up to ``bits`` one if the exact similarity is ``least`` or more.
    """

    words: int = 5
    lanes: int = 8
    bits: int = 95
    sure: int = 45
    least: float = 0.8
    index_words: int = 2
    index_lanes: int = 4

    @property
    def columns(self) -> list[str]:
        return [f"s{i}" for i in range(self.index_lanes + self.lanes)]


NARROW, WIDE = None, Wide()
_CACHE = 200_000
_ODD = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 65)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit depending on all of the input's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Bits that over half of the hashes have, for each of the lanes derived from them."""
    ones = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # a byte can count 255 rows
        rows = _mixed(hashes[at : at + 255, None] ^ _ODD[None, :lanes])
        ones += np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")


def wide_simhash(text: str, scheme: Wide, cache: dict[bytes, int]) -> np.ndarray:
    """The lanes of the index, then those that are compared; each shingle of a text counts once."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(scheme.index_lanes + scheme.lanes, dtype=np.int64)
    for w in words:
        if w not in cache:
            cache[w] = xxhash.xxh64_intdigest(w, 42)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    found = []
    with np.errstate(over="ignore"):
        for width, lanes in ((scheme.index_words, scheme.index_lanes), (scheme.words, scheme.lanes)):
            n, width = max(1, len(h) - width + 1), min(width, len(h))
            shingles = np.unique(_mixed(sum(h[i : i + n] * _ODD[i] for i in range(width))))
            found.append(_majority(shingles, lanes))
    return np.concatenate(found)


def wide_fingerprints(df: DataFrame, scheme: Wide = WIDE, text: str = "text", into: str = "sig") -> DataFrame:
    """Adds the struct of lanes of each whole text."""

    @F.pandas_udf(", ".join(f"{c} long" for c in scheme.columns))
    def lanes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release_tokens()
        cache: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for t in batch.fillna(""):
                if len(cache) > _CACHE:
                    cache.clear()
                rows.append(wide_simhash(t, scheme, cache))
            yield pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, len(scheme.columns)), columns=scheme.columns)

    return small_batches(df).withColumn(into, lanes(F.col(text)))


def shingle_sets(df: DataFrame, words: int, text: str = "text", into: str = "shingles") -> DataFrame:
    """Adds the distinct shingles of each whole text, as sorted hashes of 64 bits."""

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch.fillna(""):
                w = t.encode("utf-8", "replace").lower().split()
                parts = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
                out.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 7) for x in parts), dtype=np.uint64)).view(np.int64))
            yield pd.Series(out, dtype=object)

    return df.withColumn(into, sets(F.col(text)))


def wide_spanning_links(ids: np.ndarray, lanes: np.ndarray, sure: int, bits: int, each: int = 3) -> list[tuple[int, int, int]]:
    """Edges (id, id, differing bits): those that connect what sure pairs connect, then the nearest between the groups."""
    order = np.argsort(ids)  # every key searches from the smallest id on, so keys of one family give the same edges
    ids, lanes = ids[order], lanes[order].view(np.uint64)  # of signed numbers the bits of the absolute value would be counted
    apart = lambda x, of: np.bitwise_count(lanes[of] ^ lanes[x]).sum(axis=1, dtype=np.int64)
    edges: list[tuple[int, int, int]] = []
    group, rest = np.arange(len(ids)), np.arange(len(ids))
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        root = stack[0]
        while stack and len(rest):
            x = stack.pop()
            d = apart(x, rest)
            near = d <= sure
            if near.any():
                edges += [(int(ids[y]), int(ids[x]), int(n)) for y, n in zip(rest[near], d[near], strict=True)]
                group[rest[near]] = root
                stack += rest[near].tolist()
                rest = rest[~near]
    everyone = np.arange(len(ids))
    while True:
        roots, sizes = np.unique(group, return_counts=True)
        if len(roots) < 2:
            return edges
        found: dict[int, list[tuple[int, int, int]]] = {}
        for x in everyone[group != roots[sizes.argmax()]]:
            d = apart(x, everyone)
            d[group == group[x]] = bits + 1
            for y in np.argsort(d, kind="stable")[:each]:
                if d[y] <= bits:
                    found.setdefault(int(group[x]), []).append((int(d[y]), int(x), int(y)))
        if not found:
            return edges
        for near in found.values():
            near.sort()
            edges += [(int(ids[x]), int(ids[y]), n) for n, x, y in near[:each]]
            _, x, y = near[0]
            group[group == group[x]] = group[y]


def wide_links(distinct: DataFrame, scheme: Wide = WIDE, crowd: int = CROWD, pairs_up_to: int = PAIRS) -> DataFrame:
    """Edges (x, y, apart) between rows (fp, lanes) of ``distinct`` whose compared lanes differ in ``apart``, at most ``scheme.bits``.

    Candidates share a key of the index.  Keys of up to ``crowd`` members are verified in pairs or
    searched as one group; more members are dealt into blocks of half that size, and every two blocks
    of a key are searched together, so a task's memory is bounded and no candidate is left out.
    """
    pairs, members = _candidates(distinct, scheme, pairs_up_to)
    return _spanning(scheme, crowd, pairs, members.join(_compared(distinct, scheme), "fp"))


def _spanning(scheme: Wide, crowd: int, pairs: DataFrame, members: DataFrame) -> DataFrame:
    def search(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(wide_spanning_links(g["fp"].to_numpy(), _lanes_of(g, scheme), scheme.sure, scheme.bits), columns=["x", "y", "apart"], dtype="int64")

    searched = _dealt(members.select("key", "fp", "n", *scheme.columns[scheme.index_lanes :]), crowd).groupBy("key", "i", "j").applyInPandas(search, "x long, y long, apart long")
    return _edges(pairs, searched)


def _compared(distinct: DataFrame, scheme: Wide) -> DataFrame:
    return distinct.select("fp", *scheme.columns[scheme.index_lanes :])


def _lanes_of(g: pd.DataFrame, scheme: Wide) -> np.ndarray:
    return np.ascontiguousarray(g[scheme.columns[scheme.index_lanes :]].to_numpy(np.int64))


def _edges(*parts: DataFrame) -> DataFrame:
    """Edges with the smaller end first, each once."""
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "apart").distinct()


def _candidates(distinct: DataFrame, scheme: Wide, pairs_up_to: int) -> tuple[DataFrame, DataFrame]:
    """Near pairs (x, y, apart) of keys of up to ``pairs_up_to`` members, and the members (key, fp, n) of larger keys."""
    compared = scheme.columns[scheme.index_lanes :]
    spread = distinct.repartition(max(1, -(-distinct.count() // SPREAD)))
    segment = lambda s: F.shiftrightunsigned(F.col(f"s{s // 2}"), 32 * (s % 2)).bitwiseAND(F.lit(_LOW))
    keys = F.array(*(F.lit((s * 8 + w) << 32).bitwiseOR(segment(s).bitwiseAND(F.lit(_LOW ^ (15 << 4 * w)))) for s in range(2 * scheme.index_lanes) for w in range(8)))
    keyed = spread.select("fp", F.explode(keys).alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).where("n > 1"))
    more = cut(keyed.join(shared.where("n > 2").select("key", "n"), "key"))
    few = more.where(F.col("n") <= pairs_up_to).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("x")).join(few.select("key", F.col("fp").alias("y")), "key").where("x < y").select("x", "y")
    pairs = shared.where("n = 2").select("x", "y").unionByName(pairs).distinct()
    side = lambda name: distinct.select(F.col("fp").alias(name), F.struct(*compared).alias(f"l{name}"))
    apart = sum((F.bit_count(F.col(f"lx.{c}").bitwiseXOR(F.col(f"ly.{c}"))) for c in compared[1:]), F.bit_count(F.col(f"lx.{compared[0]}").bitwiseXOR(F.col(f"ly.{compared[0]}"))))
    near = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", apart.alias("apart")).where(F.col("apart") <= scheme.bits)
    return near.withColumn("apart", F.col("apart").cast("long")), more.where(F.col("n") > pairs_up_to).select("key", "fp", "n")


def _dealt(members: DataFrame, crowd: int) -> DataFrame:
    """Members of keys with more than ``crowd`` of them (n) in blocks of half that size, every two blocks (i, j) of a key together."""
    blocks = F.when(F.col("n") > crowd, F.ceil(F.col("n") / F.lit(max(1, crowd // 2)))).otherwise(1).cast("int")
    dealt = members.withColumn("m", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("m", "other")


def shared_first(apart: np.ndarray, number: int) -> np.ndarray:
    """Of rows that share the key of this number (segment and wildcard), those that share no earlier one; ``apart`` has the differing bits of the segments."""
    segment, wildcard = divmod(number, 8)
    v = apart[:, : segment + 1]
    fours = np.bitwise_count((v | v >> np.uint32(1) | v >> np.uint32(2) | v >> np.uint32(3)) & np.uint32(0x11111111))
    own = (fours[:, segment] > 0) | (wildcard == 0)  # equal segments agree under every wildcard
    return own & (fours[:, :segment] > 1).all(axis=1)


def between_classes(g: pd.DataFrame, scheme: Wide, each: int) -> tuple[list[tuple[int, int, int]], bool]:
    """For every label but the most frequent one its ``each`` nearest pairs (id, id, differing bits) with others, and whether there are more.

    ``g`` has members of one key, of one block or of two.  Left out are pairs that another group lists: those within one of
    two blocks, and those that share an earlier key (there they lie between the same classes, or were verified in pairs).
    """
    ids, lanes, labels, own = g["fp"].to_numpy(), _lanes_of(g, scheme).view(np.uint64), g["label"].to_numpy(), g["own"].to_numpy()
    segments = np.ascontiguousarray(g[scheme.columns[: scheme.index_lanes]].to_numpy("<i8")).view("<u4")
    key, two = int(g["key"].iloc[0]) >> 32, g["i"].iloc[0] != g["j"].iloc[0]
    names, sizes = np.unique(labels, return_counts=True)
    found: list[tuple[int, int, int]] = []
    more = False
    for name in np.delete(names, sizes.argmax()):
        inside = np.flatnonzero(labels == name)
        outside = np.flatnonzero(labels != name)
        near: list[tuple[int, int, int]] = []
        for x in inside:
            d = np.bitwise_count(lanes[outside] ^ lanes[x]).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(d <= scheme.bits)
            if two:
                hit = hit[own[outside[hit]] != own[x]]
            hit = hit[shared_first(segments[outside[hit]] ^ segments[x], key)]
            near += zip(d[hit].tolist(), [int(ids[x])] * len(hit), ids[outside[hit]].tolist(), strict=True)
            if len(near) > 2 * each:
                near, more = heapq.nsmallest(each, near), True
        more = more or len(near) > each
        found += [(x, y, n) for n, x, y in heapq.nsmallest(each, near)]
    return found, more


def _between(scheme: Wide, each: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def search(g: pd.DataFrame) -> pd.DataFrame:
        pairs, more = between_classes(g, scheme, each)
        return pd.DataFrame(pairs, columns=["x", "y", "apart"], dtype="int64").assign(more=more)

    return search


def wide_classes(distinct: DataFrame, texts: DataFrame, scheme: Wide = WIDE, crowd: int = CROWD, pairs_up_to: int = PAIRS, each: int = 4_096) -> DataFrame:
    """(fp, label) of every row of ``distinct``: the classes that all candidates that are links make; ``texts`` is (fp, text).

    What :func:`wide_links` finds is verified first.  Then, of crowded keys that hold several classes, the ``each`` nearest
    pairs between a class and the others are verified, 64 times as many in each round, until no key has more.
    Blocks of ``BETWEEN`` members bound the pairs of a task.
    """
    pairs, members = _candidates(distinct, scheme, pairs_up_to)
    # a row for each fingerprint, so lanes and labels are joined with it and not with its up to 64 memberships
    crowded = cut(members.groupBy("fp").agg(F.collect_list(F.struct("key", "n")).alias("keys")).join(distinct.select("fp", *scheme.columns), "fp"))
    memberships = lambda of: of.select("*", F.inline("keys")).drop("keys")
    near = cut(_spanning(scheme, crowd, pairs, memberships(crowded)))
    linked = cut(verified_links(near, texts, scheme))
    tested = near.select("x", "y")
    while True:
        labels = cut(_classes(distinct.select("fp"), linked))
        several = memberships(cut(crowded.join(labels, "fp")))
        mixed = several.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
        dealt = _dealt(several.join(mixed, "key"), min(crowd, BETWEEN))
        found = cut(dealt.groupBy("key", "i", "j").applyInPandas(_between(scheme, each), "x long, y long, apart long, more boolean"))
        new = cut(_edges(found.select("x", "y", "apart")).join(tested, ["x", "y"], "left_anti"))
        n, more = new.count(), found.where("more").limit(1).count()
        if n:
            linked = cut(linked.unionByName(verified_links(new, texts, scheme)))
            tested = cut(tested.unionByName(new.select("x", "y")))
        if not more:
            return labels if not n else _classes(distinct.select("fp"), linked)
        each *= 64


def verified_links(edges: DataFrame, texts: DataFrame, scheme: Wide = WIDE) -> DataFrame:
    """The edges (x, y) that are links: sure ones, and the others by exact similarity; ``texts`` is (fp, text)."""
    edges = cut(edges)
    doubtful = edges.where(F.col("apart") > scheme.sure).select("x", "y")
    return edges.where(F.col("apart") <= scheme.sure).select("x", "y").unionByName(_exact(doubtful, texts, scheme))


def _exact(pairs: DataFrame, texts: DataFrame, scheme: Wide) -> DataFrame:
    """The pairs (x, y) whose sets of shingles are similar; a task takes families of pairs, or two blocks of one that is large or has many pairs."""
    family = cut(components(pairs).select(F.col("node").alias("fp"), "component"))
    sets = cut(shingle_sets(texts.join(family.select("fp"), "fp", "left_semi"), scheme.words).select("fp", "shingles"))
    sized = family.join(sets.select("fp", F.size("shingles").alias("size")), "fp")
    of_family = cut(pairs.join(family.withColumnRenamed("fp", "x"), "x"))
    many = of_family.groupBy("component").agg(F.count("*").alias("many"))
    weight = cut(sized.groupBy("component").agg(F.sum("size").alias("weight")).join(many, "component"))
    total = weight.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    homes = max(4 * pairs.sparkSession.sparkContext.defaultParallelism, -(-total // SETS))
    large = (F.col("weight") > SETS) | (F.col("many") > VERIFIED)
    home = F.when(large, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(homes)))
    blocks = F.when(large, F.ceil(F.greatest(F.col("weight") / F.lit(SETS // 2), F.sqrt(2 * F.col("many") / F.lit(VERIFIED))))).otherwise(1)
    placed = weight.select("component", large.alias("large"), home.alias("home"), blocks.alias("blocks"))
    block = lambda name: F.pmod(F.xxhash64(name), F.col("blocks"))
    at = ["large", "home", "i", "j"]
    dealt = cut(of_family.join(placed, "component").select("large", "home", F.least(block("x"), block("y")).alias("i"), F.greatest(block("x"), block("y")).alias("j"), "x", "y"))
    needed = dealt.select(*(F.col(c).alias(f"of_{c}") for c in at), F.explode(F.array("x", "y")).alias("fp")).distinct().join(sets, "fp")

    def verify(p: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(own["fp"].tolist(), own["shingles"], strict=True))
        alike = []
        for x, y in zip(p["x"].tolist(), p["y"].tolist(), strict=True):
            a, b = of[x], of[y]
            if min(len(a), len(b)) >= scheme.least * max(len(a), len(b)) * (1 - 1e-9):  # else not even one within the other
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both / (len(a) + len(b) - both) >= scheme.least:
                    alike.append((x, y))
        return pd.DataFrame(alike, columns=["x", "y"], dtype="int64")

    return dealt.groupBy(*at).cogroup(needed.groupBy(*(f"of_{c}" for c in at))).applyInPandas(verify, "x long, y long")


def _classes(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, label): the label is the smallest fingerprint that edges reach."""
    found = components(edges)
    return distinct.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"))


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **tiers: int) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links."""
    fps = cut(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    known = distinct.where("node is not null")
    labels = _classes(known, links(known.select("fp"), **tiers))
    smallest = known.join(labels, "fp").groupBy("label").agg(F.min("node").alias("component_id"))
    classes = labels.join(smallest, "label").select("fp", "component_id")
    return fps.join(classes, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scheme: Wide = WIDE, **tiers: int) -> DataFrame:
    """The rows of ``df`` that represent their class of near copies: one row, of the smallest id (then text hash).

    Rows of one id with unrelated texts are unrelated rows and each is judged by its text.  Every row
    with a null id is kept.  Columns stay as they are.
    """
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = wide_fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), scheme)
    rows = rows.where("doc_id is not null").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "sig.*")
    rows = cut(rows.withColumn("fp", F.xxhash64(*scheme.columns)))
    distinct = cut(rows.groupBy("fp").agg(*(F.max(c).alias(c) for c in scheme.columns)))
    one = cut(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("first")))
    named = df.where(F.col(doc_id).isNotNull())
    # a text for each fingerprint, read only for those that have an edge to verify
    own = named.select(F.col(doc_id).alias("i"), th.alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = own.join(one, (F.col("i") == F.col("first.doc_id")) & (F.col("h") == F.col("first.th"))).select("fp", "text")
    labels = wide_classes(distinct, texts, scheme, **tiers)
    first = one.join(labels, "fp").groupBy("label").agg(F.min("first").alias("first"))
    first = first.select(F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__th"))
    kept = named.withColumn("__own", th).join(first, (F.col(doc_id) == F.col("__id")) & (F.col("__own") == F.col("__th")), "left_semi")
    return kept.dropDuplicates([doc_id, "__own"]).drop("__own").unionByName(df.where(F.col(doc_id).isNull()))
