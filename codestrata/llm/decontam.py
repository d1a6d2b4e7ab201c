"""Benchmark decontamination.

Method: template canonicalisation.  Numbers, names (capitalised words) and units (unit words after a
number) become typed placeholders; windows of five canonical tokens are hashed; windows of documents
and benchmark items meet in a hash join.  A capitalised word that begins a sentence may be a name or
not, so its windows are hashed both ways.  Matched windows on one alignment must fill the item's slots
consistently: one value of the item always meets one value of the document and the reverse.
Alignments at one place of the document (words may be inserted or left out between them) are united
only while their values agree.  A document in which one place covers at least ``SHARE`` of an item's
tokens contains the item, re-parameterised or not.

A template of fewer than ``LITERALS`` ordinary words says little, so such windows (arithmetic, tables of
numbers) are matched by their tokens as written, without regard to case.  An item shorter than a
window is matched whole in the same way; one of one or two tokens, which prose holds by chance, only
by a document that consists of nothing else.

The distinct window hashes of the benchmark are sent to the tasks in blocks of at most ``BLOCK`` (a
fixed bound of 8 MB), so that of a document's windows only those that some item has leave its task;
a larger benchmark takes several passes over the documents, and nothing is dropped.

Defined results: null and empty texts, and items without a token, match nothing; repeated items each
report; rows of one document id are judged one by one, and the id is reported if any of them
contains an item; an empty table on either side gives no hits; a null document id is an id.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut, release_tokens, small_batches

WIDTH, LITERALS, SHARE, BLOCK = 5, 3, 0.6, 1_000_000
#: Shorter items are matched by whole documents only.
PHRASE = 3
CACHE = 200_000
#: No two of the alternatives begin alike; the second pattern finds the same in ASCII texts.
_TOKEN, _ASCII = re.compile(r"[^\W\d_]+|[.!?:;\n]|\d+(?:[.,:/]\d+)*"), re.compile(r"[a-zA-Z]+|[.!?:;\n]|[0-9]+(?:[.,:/][0-9]+)*")
#: Unit words and symbols that follow a number.
UNITS = frozenset(
    "mm cm m km g kg mg t lb lbs oz ft inch inches mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "gram grams kilogram kilograms ton tons liter liters litre litres ml s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years dollar dollars cent cents euro euros pound pounds percent degree degrees mph kmh".split()
)
_P = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WIDTH)], dtype=np.uint64)
_NUMBER, _NAME, _UNIT = (np.uint64(xxhash.xxh64_intdigest(s)) for s in ("\0number", "\0name", "\0unit"))
#: Windows as written, and items of 1, 2, ... tokens, are hashes of their own kind.
_WRITTEN = [np.uint64(xxhash.xxh64_intdigest(f"\0written{n}")) for n in range(WIDTH + 1)]
_PLAIN, _TITLE, _DIGITS, _BREAK = range(4)


class Tokens(dict):
    """Codes of the token strings met so far; kinds and hashes are arrays that a text's codes index."""

    def __init__(self):
        super().__init__()
        self.kind, self.unit, self.hash = np.zeros(1024, np.uint8), np.zeros(1024, bool), np.zeros(1024, np.uint64)

    def __missing__(self, tok: str) -> int:
        code = self[tok] = len(self)
        if code == len(self.kind):
            self.kind, self.unit, self.hash = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.unit, self.hash))
        first, low = tok[0], tok.lower()
        self.kind[code] = _BREAK if first in ".!?:;\n" else _DIGITS if first.isdigit() else _TITLE if first.isupper() and tok[1:].islower() else _PLAIN
        self.unit[code] = low in UNITS
        self.hash[code] = xxhash.xxh64_intdigest(low)
        return code

    def read(self, text: str) -> tuple[list[str], np.ndarray]:
        if len(self) > CACHE:
            self.clear()
        toks = (_ASCII if text.isascii() else _TOKEN).findall(text)
        return toks, np.fromiter(map(self.__getitem__, toks), dtype=np.int64, count=len(toks))


class Wanted:
    """Sorted hashes, and a table by their upper bits that most other hashes miss (16 bytes a hash at most, and a megabyte)."""

    def __init__(self, hashes: np.ndarray):
        bits = max(16, min(24, len(hashes).bit_length() + 3))
        self.hashes, self.shift, self.table = hashes, np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.table[hashes.view(np.uint64) >> self.shift] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the given hashes (unsigned) are among the wanted ones."""
        at = np.flatnonzero(self.table[hashes >> self.shift])
        if not len(at):
            return at
        signed = hashes[at].view(np.int64)
        return at[self.hashes[np.minimum(np.searchsorted(self.hashes, signed), len(self.hashes) - 1)] == signed]


def _windows_of(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1  # arrays wrap around without a warning
    total = h[:n] * _P[0]
    for i in range(1, width):
        total += h[i : i + n] * _P[i]
    return total


def _counts(flags: np.ndarray) -> np.ndarray:
    """Of every ``WIDTH`` neighbours, how many are set."""
    ones, n = flags.view(np.uint8), len(flags) - WIDTH + 1
    total = ones[:n] + ones[1 : n + 1]
    for i in range(2, WIDTH):
        total += ones[i : i + n]
    return total


def template_windows(text: str, tokens: Tokens, wanted: np.ndarray | Wanted | None = None, shorter: frozenset[int] | None = None) -> tuple[int, list[tuple[int, int, list[tuple[int, str]]]]]:
    """The number of tokens, and (hash, position, slots as (offset, value)) of the windows.

    ``wanted`` (sorted hashes) and ``shorter`` (token counts of short items) select what a document
    looks for; without them the text is an item, all its windows are given, or itself if it is short.
    """
    item = wanted is None
    if not item and not isinstance(wanted, Wanted):
        wanted = Wanted(wanted)
    toks, codes = tokens.read(text)
    kind = tokens.kind[codes]
    kept = np.flatnonzero(kind != _BREAK)
    n = len(kept)
    if not n or not item and not len(wanted.hashes):
        return n, []
    before = np.empty_like(kind)
    before[0], before[1:] = _BREAK, kind[:-1]
    kind, before, codes = kind[kept], before[kept], codes[kept]
    written = tokens.hash[codes]
    digits, title, unit = kind == _DIGITS, kind == _TITLE, tokens.unit[codes] & (before == _DIGITS)
    opening = title & (before == _BREAK)
    inside = title & ~opening
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []  # hashes, positions, tokens that are slots

    def take(hashes: np.ndarray, chosen: np.ndarray | None, slots: np.ndarray) -> None:
        if wanted is not None:
            at = wanted.places(hashes)
            at = at if chosen is None else at[chosen[at]]
        else:
            at = np.arange(len(hashes)) if chosen is None else np.flatnonzero(chosen)
        if len(at):
            found.append((hashes[at].view(np.int64), at, slots))

    if n >= WIDTH:
        few = digits | inside | unit
        as_word = written.copy()
        as_word[unit], as_word[inside], as_word[digits] = _UNIT, _NAME, _NUMBER
        blanks = _counts(few)
        many = blanks <= WIDTH - LITERALS
        take(_windows_of(as_word, WIDTH), many, few)
        if opening.any():
            either = _counts(opening)
            as_name = as_word.copy()
            as_name[opening] = _NAME
            take(_windows_of(as_name, WIDTH), (either > 0) & (_counts(few | opening) <= WIDTH - LITERALS), few | opening)
        if not many.all():
            take(_windows_of(written, WIDTH) ^ _WRITTEN[WIDTH], ~many, digits)
    for width in range(1, min(WIDTH - 1, n) + 1):
        if (n == width) if item or width < PHRASE else width in (shorter or ()):
            take(_windows_of(written, width) ^ _WRITTEN[width], None, digits)
    if not found:
        return n, []
    out = []
    for hashes, places, slots in found:
        for h, i in zip(hashes.tolist(), places.tolist(), strict=True):
            out.append((h, i, [(j, toks[kept[i + j]].lower()) for j in np.flatnonzero(slots[i : i + WIDTH]).tolist()]))
    return n, out


def covered_tokens(matches: list[tuple[int, int, list[tuple[str, str]]]], n_tokens: int) -> int:
    """Most item tokens that one place of a document covers consistently.

    ``matches`` are (position in the document, position in the item, (item value, document value) of each
    slot).  An alignment is one difference of positions, judged as a whole.  A place is a stretch of two
    item lengths of such differences; places overlap by half, so alignments up to an item's length
    apart, by words put in or left out, meet in one of them.
    """
    width = min(WIDTH, n_tokens)
    places: dict[int, list] = defaultdict(list)
    for m in matches:
        at = (m[0] - m[1]) // n_tokens
        for p in (at - 1, at):
            places[p].append(m)
    best = 0
    for found in places.values():
        alignments: dict[int, list] = defaultdict(list)
        for pos, bpos, slots in found:
            alignments[pos - bpos].append((bpos, slots))
        if len(found) * width <= best:
            continue
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        covered: set[int] = set()
        for group in sorted(alignments.values(), key=len, reverse=True):
            pairs = {p for _, slots in group for p in slots}
            one, other = dict(pairs), {d: b for b, d in pairs}
            if len(one) < len(pairs) or len(other) < len(pairs):
                continue
            if any(there.get(b, d) != d or back.get(d, b) != b for b, d in pairs):
                continue
            there |= one
            back |= other
            covered.update(t for bpos, _ in group for t in range(bpos, bpos + width))
        best = max(best, len(covered))
        if best >= n_tokens:
            break
    return min(best, n_tokens)


_FOUND = "array<struct<hash:long,pos:int,slots:array<struct<at:int,value:string>>>>"


def _item_windows(df: DataFrame, text: str) -> DataFrame:
    @F.pandas_udf(f"n int, w {_FOUND}")
    def cutter(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            yield pd.DataFrame([template_windows(t or "", tokens) for t in batch], columns=["n", "w"])

    return small_batches(df).withColumn("__w", cutter.asNondeterministic()(F.col(text)))


def _wanted_windows(df: DataFrame, text: str, wanted: np.ndarray, shorter: frozenset[int]) -> DataFrame:
    @F.pandas_udf(_FOUND)
    def cutter(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens, looked_for = Tokens(), Wanted(wanted)
        release_tokens()
        for batch in batches:
            yield pd.Series([template_windows(t or "", tokens, looked_for, shorter)[1] for t in batch], dtype=object)

    # nondeterministic, so that filters on the windows do not evaluate the function a second time below them,
    # in a second Python worker of each task
    return small_batches(df).withColumn("__w", cutter.asNondeterministic()(F.col(text)))


def _found(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, share: float, block: int) -> DataFrame:
    """(doc_id, th, item_id, covered, item_tokens, share) of each row that contains an item; th is its text's hash."""
    items = cut(benchmark.select(F.col(item_id).alias("item_id"), F.monotonically_increasing_id().alias("copy"), F.col(item_text).alias("text")))
    read = cut(_item_windows(items, "text").select("item_id", "copy", "__w.n", "__w.w"))
    bench = read.select("item_id", "copy", "n", F.explode("w").alias("w")).select("item_id", "copy", "n", F.col("w.hash").alias("hash"), F.col("w.pos").alias("bpos"), F.col("w.slots").alias("bslots"))
    shorter = frozenset(r[0] for r in read.where(F.col("n") < WIDTH).select("n").distinct().collect())
    passes = max(1, math.ceil(bench.count() / block))
    met = None
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    for i in range(passes):
        part = bench.where(F.pmod(F.xxhash64("hash"), F.lit(passes)) == i)
        wanted = np.unique(np.array([r[0] for r in part.select("hash").distinct().collect()], dtype=np.int64))
        got = _wanted_windows(source, "text", wanted, shorter).select("doc_id", F.xxhash64("text").alias("th"), F.explode("__w").alias("w"))
        got = got.select("doc_id", "th", F.col("w.hash").alias("hash"), F.col("w.pos").alias("pos"), F.col("w.slots").alias("slots")).join(part, "hash")
        met = got if met is None else met.unionByName(got)
    # a hash holds the kinds of its tokens, so both sides have their slots at the same offsets
    values = F.zip_with("bslots", "slots", lambda b, d: F.struct(b["value"].alias("b"), d["value"].alias("d")))
    grouped = met.groupBy("doc_id", "th", "item_id", "copy", "n").agg(F.collect_set(F.struct("pos", "bpos", values.alias("slots"))).alias("m"))

    @F.pandas_udf("int")
    def covered(matches: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([covered_tokens([(x["pos"], x["bpos"], [(s["b"], s["d"]) for s in x["slots"]]) for x in m], k) for m, k in zip(matches, n, strict=True)], dtype="int32")

    scored = grouped.select("doc_id", "th", "item_id", F.col("n").alias("item_tokens"), covered.asNondeterministic()("m", "n").alias("covered"))
    return scored.withColumn("share", F.col("covered") / F.col("item_tokens")).where(F.col("share") >= share)


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, share) for each document that contains an item."""
    scored = _found(docs, benchmark, doc_id, text, item_id, item_text, share, block)
    return scored.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("item_tokens").alias("item_tokens"), F.max("share").alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; columns stay as they are."""
    bad = _found(docs, benchmark, doc_id, text, item_id, item_text, share, block).select(F.col("doc_id").alias("__bad"), F.col("th").alias("__th")).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__bad")) & (F.xxhash64(text) == F.col("__th")), "left_anti")
