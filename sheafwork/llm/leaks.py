"""Held-out passages inside a corpus, found by spaced-seed hashing and verified word by word.

A seed is a fixed mask over consecutive words: positions marked 1 are hashed, the others may differ. Every window of
28 words with at most three changed words holds a hit of the first mask (all patterns are tried in the tests); two
more masks widen what longer passages hit. A hit gives an item and a diagonal, and the passage around it counts when
some stretch of at least ``min_words`` words on that diagonal has at most one word in ``one_in`` changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.session import spread

MASKS = ("11110110111", "1110101100111", "101001101111")
MIN_WORDS, ONE_IN = 28, 8
#: Items of about so many characters travel to the workers as one index; a larger test set goes in several blocks.
INDEX_CHARS = 20_000_000
_MARKS = re.compile(r"[^\w\s]+|_+")


def words(text: str | None) -> list[str]:
    """Words for comparison: split at blanks, letters and digits only, without case."""
    return _MARKS.sub("", text.lower()).split() if text else []


_OFFSETS = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
_MIX = np.random.default_rng(20240607).integers(1, 2**63, size=(len(MASKS), max(map(len, MASKS))), dtype=np.uint64) | np.uint64(1)
_GAP = max(map(len, MASKS)) - 1


def seed_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """The hash of mask ``k`` at every position of ``ids`` (uint64 word codes) where it fits."""
    n = len(ids) - len(MASKS[k]) + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for o in _OFFSETS[k]:
        out += ids[o : o + n] * _MIX[k][o]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def passage(same: np.ndarray, min_words: int = MIN_WORDS, one_in: int = ONE_IN) -> tuple[int, int] | None:
    """The longest stretch [a, b) of at least ``min_words`` in which at most one position in ``one_in`` differs."""
    n = len(same)
    if n < min_words or n - int(same.sum()) == n:
        return None
    height = np.concatenate([[0], np.cumsum(np.where(same, -1, one_in - 1))])
    best = None
    # stretch [a, b) is good when height[b] <= height[a]; the earliest a at or above each level gives the longest one
    top = np.maximum.accumulate(height)
    a = np.searchsorted(top, height, side="left")
    length = np.arange(n + 1) - a
    b = int(np.argmax(length))
    if length[b] >= min_words:
        best = (int(a[b]), b)
    return best


class Index:
    """The seeds of all items, for one worker."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.item_ids, starts, codes = [], [0], []
        for item_id, text in items:
            self.item_ids.append(item_id)
            codes += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            starts.append(len(codes))
        self.codes = np.array(codes, dtype=np.uint64)
        self.starts = np.array(starts)
        self.tables = []
        for k in range(len(MASKS)):
            keys, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for a, b in zip(starts, starts[1:]):
                h = seed_hashes(self.codes[a:b], k)
                keys.append(h)
                at.append(a + np.arange(len(h)))
            key, pos = np.concatenate(keys), np.concatenate(at)
            order = np.argsort(key, kind="stable")
            bits = np.zeros(1 << 22, dtype=bool)
            bits[key >> np.uint64(42)] = True
            self.tables.append((key[order], pos[order], bits))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word codes of all texts in one row, 0 for a word of no item, with a gap after each text; and text starts."""
        get, parts, starts, n = self.vocabulary.get, [], [0], 0
        for t in texts:
            w = words(t)
            parts.append(np.fromiter((get(x, 0) for x in w), dtype=np.uint64, count=len(w)))
            parts.append(np.zeros(_GAP, dtype=np.uint64))
            n += len(w) + _GAP
            starts.append(n)
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.array(starts)

    def find(self, texts: list[str | None], min_words: int = MIN_WORDS, one_in: int = ONE_IN) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, longest passage in words, first word in the item, changed words), one per leaked pair."""
        codes, starts = self.encode(texts)
        if not len(codes) or not len(self.codes):
            return []
        found = []
        for k, (key, pos, bits) in enumerate(self.tables):
            h = seed_hashes(codes, k)
            hit = np.flatnonzero(bits[h >> np.uint64(42)])
            lo, hi = np.searchsorted(key, h[hit], "left"), np.searchsorted(key, h[hit], "right")
            n = hi - lo
            at = np.repeat(hit, n)
            first = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([at, pos[first]], axis=1))
        hits = np.concatenate(found)
        if not len(hits):
            return []
        doc = np.searchsorted(starts, hits[:, 0], "right") - 1
        item = np.searchsorted(self.starts, hits[:, 1], "right") - 1
        lines = np.unique(np.stack([doc, item, hits[:, 0] - hits[:, 1]], axis=1), axis=0)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, shift in lines.tolist():
            a, b = int(self.starts[i]), int(self.starts[i + 1])
            lo, hi = max(a, int(starts[d]) - shift), min(b, int(starts[d + 1]) - _GAP - shift)
            if hi - lo < min_words:
                continue
            same = self.codes[lo:hi] == codes[lo + shift : hi + shift]
            span = passage(same, min_words, one_in)
            if span and span[1] - span[0] > best.get((d, i), (0,))[0]:
                best[d, i] = (span[1] - span[0], lo - a + span[0], int((~same[span[0] : span[1]]).sum()))
        return [(d, self.item_ids[i], *v) for (d, i), v in sorted(best.items())]


OUT = "doc_id long, item_id long, n_words int, item_word int, n_changed int"


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, one_in: int = ONE_IN, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, n_words, item_word, n_changed): documents holding a passage of an item, with the longest passage.

    ``documents`` needs ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``; null and empty texts match nothing,
    a pair is given once however often it occurs, repeated rows of one id count once, other columns are ignored. The
    index of a block of items is sent to the workers and all documents are held against it; a test set of more than
    ``index_chars`` characters makes several blocks, and the result doesn't depend on their number.
    """
    items = items.select("item_id", "text").where(F.length("text") > 0).groupBy("item_id").agg(F.max("text").alias("text"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).head()
    blocks = max(1, min(n, -(-size // max(1, index_chars))))
    texts = spread(documents.select("doc_id", "text").where(F.length("text") > 0))
    out = None
    for i in range(blocks):
        held = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()]
        one = _against(texts, held, min_words, one_in)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("n_changed")).alias("c"), (-F.col("item_word")).alias("w"))).alias("_x")).select("doc_id", "item_id", F.col("_x.n_words").alias("n_words"), (-F.col("_x.w")).alias("item_word"), (-F.col("_x.c")).alias("n_changed"))


def _against(texts: DataFrame, held: list[tuple[int, str]], min_words: int, one_in: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(sent.value)
        for batch in batches:
            ids = batch["doc_id"].tolist()
            for a in range(0, len(batch), 2000):
                rows = index.find(batch["text"][a : a + 2000].tolist(), min_words, one_in)
                yield pd.DataFrame([(ids[a + d], *rest) for d, *rest in rows], columns=["doc_id", "item_id", "n_words", "item_word", "n_changed"])

    return texts.mapInPandas(run, OUT)


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_documents, longest, leaked): one row per item; an item that no document holds has 0."""
    by = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest"))
    joined = items.select("item_id").distinct().join(by, "item_id", "left")
    return joined.select("item_id", F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"), F.coalesce("longest", F.lit(0)).alias("longest"), F.col("n_documents").isNotNull().alias("leaked"))
