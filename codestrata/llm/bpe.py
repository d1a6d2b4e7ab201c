"""BPE encoding and decoding with a public vocabulary.

Method: a pair occurrence index.  The distinct new words of a batch are laid out in one linked
symbol list; every adjacent pair that has a merge rank maps to all its positions in the batch.
Active ranks are taken in ascending order, each rank is applied to all its positions at once, and
only the lists of the neighbouring pairs change.  Words already seen in the partition come from a
bounded cache.

Defined results: null text encodes as empty; strings of special tokens inside a text become their
special id; symbols without a vocabulary entry are dropped, as the public library does; repeated rows
are encoded each; a very long text is encoded whole, merged alone; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import small_batches

#: Words of a generation of the cache; a Python worker keeps two, over all its tasks.
CACHE_WORDS = 120_000
#: Characters of the texts whose words are held, and merged, at once.
CHUNK = 500_000
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The words of texts of Latin-1 characters, by small classes.
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_LATIN = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: Letters, numbers, capitals and their small letters that Unicode 16 added, which the
#: public library knows and this Python's tables may not.
_NEW_LETTERS = "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
_NEW_NUMBERS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
_NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}}
#: Capitals of Unicode 17, which the public library lowers but does not take for letters.
_NEW_CAPITALS |= {0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
_CAPITAL = re.compile(f"[{''.join(map(chr, _NEW_CAPITALS))}]")


def _ranges(kind: str) -> str:
    """The characters of a general category of Unicode 15.1, as ranges of a pattern."""
    newer = re.compile(f"[{_NEW_LETTERS}{_NEW_NUMBERS}]")
    out: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind and not newer.match(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def _any_words() -> re.Pattern:
    """Words of any text; letters and numbers are those of Unicode 16, as in the public library."""
    letter, number = _ranges("L") + _NEW_LETTERS, _ranges("N") + _NEW_NUMBERS
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+")


def _byte_symbols() -> list[str]:
    """The printable symbol of each byte: printable Latin-1 stands for itself, others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Vocabulary:
    """Symbols, merge ranks and special tokens of a tokenizer file with end-of-word marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = _byte_symbols()
        self.inner = [ids.get(s, -1) for s in symbols]
        self.last = [ids.get(s + end, -1) for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.by_rank = {rank: (pair, new) for pair, (rank, new) in self.merges.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.full(max([*ids.values(), *self.special.values()]) + 1, "", dtype=object)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        # a word's ids are kept as packed bytes, a third of a list's size, and a text's ids are their concatenation
        self.young: dict[str | int, bytes] = {}
        self.old: dict[str | int, bytes] = {}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, by the pair occurrence index over all of them."""
        sym: list[int] = []
        owner: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        for w, word in enumerate(words):
            raw = word.encode("utf-8")
            row = [x for x in (*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]) if x >= 0] if raw else []
            at, n = len(sym), len(row)
            sym += row
            owner += [w] * n
            nxt += [*range(at + 1, at + n), -1][:n] if n else []
            prv += [-1, *range(at, at + n - 1)][:n] if n else []
        merges = self.merges
        places: dict[int, list[int]] = {}
        for i, j in enumerate(nxt):
            if j >= 0 and (m := merges.get((sym[i], sym[j]))):
                places.setdefault(m[0], []).append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            todo = places.pop(rank, None)
            if not todo:
                continue
            (a, b), new = self.by_rank[rank]
            waiting: set[int] = set()
            for i in sorted(todo):
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                if owner[i] in waiting:  # a lower rank has come up in this word: it goes first
                    if rank not in places:
                        places[rank] = []
                        heapq.heappush(active, rank)
                    places[rank].append(i)
                    continue
                sym[i], sym[j] = new, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                for left, right in ((prv[i], i), (i, k)):
                    if left >= 0 and right >= 0 and (m := merges.get((sym[left], sym[right]))):
                        if m[0] not in places:
                            places[m[0]] = []
                            heapq.heappush(active, m[0])
                        places[m[0]].append(left)
                        if m[0] < rank:
                            waiting.add(owner[i])
        out: list[list[int]] = [[] for _ in words]
        for s, w in zip(sym, owner, strict=True):
            if s >= 0:
                out[w].append(s)
        return out

    def pieces(self, text: str) -> list:
        """Words of a normalised text; special tokens as their ids."""
        if "<|" in text and self.split_special.search(text):
            found: list = []
            for part in self.split_special.split(text):
                found += [self.special[part]] if part in self.special else _words(part)
            return found
        return _words(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; new words of the batch are merged together."""
        rows = [self.pieces(t) for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for w in set(chain.from_iterable(rows)):
            if w not in young:
                if (found := old.get(w)) is not None:
                    young[w] = found
                elif isinstance(w, int):
                    young[w] = np.int32(w).tobytes()
                else:
                    new.append(w)
        for w, row in zip(new, self.merge_words(new), strict=True):
            young[w] = pack(f"{len(row)}i", *row)
        return [np.frombuffer(b"".join(map(young.__getitem__, row)), dtype=np.int32) for row in rows]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.tokens[ids])


def _words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    text = text.lower()
    if text.isascii() or max(text) < "Ā":
        return _LATIN.findall(text)
    if _CAPITAL.search(text):
        text = text.translate(_NEW_CAPITALS)
    return _any_words().findall(text)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoded(vocab: Vocabulary, batch: pd.Series, chunk: int = CHUNK) -> list[np.ndarray]:
    """Ids of every text of a batch; texts are merged together up to ``chunk`` characters, a longer one alone."""
    found, waiting, size = [], [], 0
    for text in batch.fillna(""):
        if waiting and size + len(text) > chunk:
            found += vocab.encode(waiting)
            waiting, size = [], 0
        waiting.append(text)
        size += len(text)
    return found + vocab.encode(waiting)


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds ``into``, the array of token ids of each whole text.  ``path`` must be readable on executors."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_encoded(vocabulary(path), batch), dtype=object)

    return small_batches(df).withColumn(into, ids(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds ``into``: the tokens of the ids with one space between, which is how a file without decoder decodes."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for batch in batches:
            yield pd.Series([vocab.decode(np.asarray(x, dtype=np.int64)) if x is not None else "" for x in batch], dtype=object)

    return small_batches(df).withColumn(into, text(F.col(ids)))


def encode_decode(df: DataFrame, path: str, text: str = "text", into: str = "coded") -> DataFrame:
    """Adds ``into``: struct (ids, decoded), the round trip of both operators in one pass over the rows."""

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = _encoded(vocab, batch)
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([vocab.decode(x) for x in ids], dtype=object)})

    return small_batches(df).withColumn(into, both(F.col(text)))
