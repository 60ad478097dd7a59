"""Test passages in training text by spaced-seed hashing.

Fixed masks select token positions and ignore others. The hashes of all masked windows of the test items form a sorted
index, which is broadcast; the hashes of the training texts are joined against it, and around hits on neighbouring
diagonals an alignment that tolerates replaced, added and missing tokens verifies the overlap. A pair is verified if it
has as many hits as any passage that is enough must have (see `least_hits`). Where the test items are too many for one
index, texts without any hit are dropped in one pass, and only the others meet the indexes of all blocks of items.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.skew import spread
from tapeloom.session import cut_lineage

HAN = "㐀-䶿一-鿿"
TOKEN = re.compile(rf"[{HAN}]|[^\W_{HAN}]+")
#: Accents after decomposition, and characters without a form.
UNSEEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
#: Masks by the least number of tokens of the items they serve; 1 selects a token, 0 ignores it.
MASKS = {24: ("11111", "1101011", "1011101"), 10: ("1111", "110101"), 3: ("11", "101"), 1: ("1",)}
#: Tokens of test items in one broadcast index (about 60 bytes a token), and in one filter (about 30 bytes a token).
BLOCK_TOKENS, FILTER_TOKENS = 500_000, 5_000_000
#: Texts searched at a time, and the least number of diagonals in a band.
TEXTS, BAND = 200, 32
#: Share of the item a passage must hold, and edits allowed per token of the passage.
PART, EDITS = 0.5, 1 / 8
#: Costs of an edit that the alignment tries; 2 is the first, as its result can rule a pair out.
PENALTIES = (2.0, 0.5, 1.0, 4.0)
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)], dtype=np.uint64)


def tokens(text: str | None) -> list[str]:
    """Words, and single Chinese characters, in lower case without accents and punctuation."""
    if not isinstance(text, str):
        return []
    if text.isascii():
        return TOKEN.findall(text.lower())
    return TOKEN.findall(UNSEEN.sub("", unicodedata.normalize("NFKD", text.casefold())))


def least_hits(n: int) -> int:
    """The least number of windows of the contiguous mask that any passage which is enough of an item of `n` tokens keeps.

    A passage of s tokens with e edits keeps s - e tokens in e + 1 runs, and each run of r tokens r - k + 1 windows.
    """
    span = len(next(masks[0] for low, masks in MASKS.items() if n >= low))
    sizes = range(math.ceil(PART * n), n + 1)
    return max(1, min(s - int(EDITS * s) - (span - 1) * (int(EDITS * s) + 1) for s in sizes))


class Index:
    """Masked-window hashes of a block of test items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for item, text in items:
            if words := tokens(text):
                self.ids.append(item)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64))
        self.masks = []
        least = sorted(MASKS, reverse=True)
        for low in least:
            own = [k for k, a in enumerate(self.items) if len(a) >= low and not any(len(a) >= x for x in least if x > low)]
            for mask in MASKS[low]:
                picks = [i for i, c in enumerate(mask) if c == "1"]
                parts = [(self.hashes(self.items[k], picks, len(mask)), k) for k in own if len(self.items[k]) >= len(mask)]
                if parts:
                    h = np.concatenate([p for p, _ in parts])
                    item = np.concatenate([np.full(len(p), k) for p, k in parts])
                    at = np.concatenate([np.arange(len(p)) for p, _ in parts])
                    order = np.argsort(h, kind="stable")
                    self.masks.append((picks, len(mask), h[order], item[order], at[order]))
        self.need = np.array([least_hits(len(a)) for a in self.items])

    def without_items(self) -> Index:
        """Only what `touched` needs: the vocabulary and the hashes."""
        self.masks = [(picks, span, h[np.flatnonzero(np.diff(h, prepend=h[:1] - np.uint64(1)))], None, None) for picks, span, h, *_ in self.masks]
        self.ids, self.items = [], []
        return self

    def touched(self, texts: list[str | None]) -> list[bool]:
        """Whether any window of each text has the hash of a window of an item."""
        get, out = self.vocabulary.get, []
        for text in texts:
            ids = np.array([get(w, 0) for w in tokens(text)], dtype=np.int64)
            out.append(any(self._equal(ids, picks, span, h)[2].any() for picks, span, h, *_ in self.masks if len(ids) >= span))
        return out

    def _equal(self, ids: np.ndarray, picks: list[int], span: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of windows without unknown tokens, and where equal hashes begin in `h` and how many there are."""
        n = len(ids) - span + 1
        whole = np.flatnonzero(reduce(np.logical_and, (ids[p : p + n] > 0 for p in picks)))
        own = self.hashes(ids, picks, span)[whole]
        low = np.searchsorted(h, own, "left")
        some = np.flatnonzero(h[np.minimum(low, len(h) - 1)] == own)
        return whole[some], low[some], np.searchsorted(h, own[some], "right") - low[some]

    @staticmethod
    def hashes(ids: np.ndarray, picks: list[int], span: int) -> np.ndarray:
        n = len(ids) - span + 1
        return reduce(np.add, (ids[p : p + n].astype(np.uint64) * MULTIPLIERS[j] for j, p in enumerate(picks)))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in `ids`, item, position in the item) of all windows with equal hashes."""
        out = []
        for picks, span, h, item, at in self.masks:
            if len(ids) < span:
                continue
            where, low, times = self._equal(ids, picks, span, h)
            if len(where):
                first = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
                found = first + np.arange(times.sum())
                out.append((np.repeat(where, times), item[found], at[found]))
        if not out:
            return (np.empty(0, int),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def overlaps(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(number of the text, item id, matched tokens, edits) of each verified overlap."""
        gap = 32
        rows, starts, n = [], [], 0
        get = self.vocabulary.get
        for text in texts:
            ids = [get(w, 0) for w in tokens(text)]
            starts.append(n)
            rows.append(np.array(ids + [0] * gap, dtype=np.int64))
            n += len(ids) + gap
        ids = np.concatenate(rows) if rows else np.empty(0, np.int64)
        where, item, at = self.hits(ids)
        if not len(where):
            return
        doc = np.searchsorted(np.array(starts), where, "right") - 1
        key = doc * len(self.items) + item
        some = np.isin(key, self._promising(key, where - at, at))
        where, at, key = where[some], at[some], key[some]
        order = np.lexsort((where - at, key))
        where, at, key = where[order], at[order], key[order]
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
        for a, b in zip(cuts, cuts[1:]):
            d, k = divmod(int(key[a]), len(self.items))
            if best := self._verify(ids, starts[d], starts[d] + len(rows[d]) - gap, k, where[a:b], at[a:b]):
                yield d, self.ids[k], *best

    def _promising(self, key: np.ndarray, diagonal: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pairs of text and item with hits at enough positions of the item on neighbouring diagonals.

        Diagonals are taken in two overlapping sets of bands, wide enough for all edits of a passage of the longest item.
        """
        longest = max(map(len, self.items))
        width = max(BAND, 2 * (longest // 8 + 1))
        low = diagonal - diagonal.min()
        bands = int(low.max()) // width + 2
        out = []
        for shift in (0, width // 2):
            code = np.unique((key * bands + (low + shift) // width) * longest + at)
            band, count = np.unique(code // longest, return_counts=True)
            pair = band // bands
            out.append(pair[count >= self.need[pair % len(self.items)]])
        return np.unique(np.concatenate(out))

    def _verify(self, ids, first: int, last: int, k: int, where, at) -> tuple[int, int] | None:
        """The overlap of item `k` with one text around the diagonals with most hits, or None."""
        item = self.items[k]
        n = len(item)
        diagonal = where - at
        width = n // 8 + 3
        left = np.searchsorted(diagonal, diagonal - width, "left")
        weight = np.arange(len(diagonal)) - left + 1
        tried: list[int] = []
        for end in np.argsort(-weight, kind="stable").tolist():
            if any(abs(diagonal[end] - t) <= width for t in tried):
                continue
            tried.append(int(diagonal[end]))
            near = slice(int(left[end]), end + 1)
            if len(np.unique(at[near])) < self.need[k]:
                continue
            low, high = max(first, int(diagonal[near].min()) - width), min(last, int(diagonal[near].max()) + n + width)
            for penalty in PENALTIES:
                matched, edits = align(item, ids[low:high], penalty)
                if enough(n, matched, edits):
                    return matched, edits
                if penalty == 2 and matched - 2 * edits < PART * n * (1 - EDITS) * (1 - 2 * EDITS / (1 - EDITS)):
                    break  # less than any passage that is enough would reach here
        return None


def align(item: np.ndarray, passage: np.ndarray, penalty: float) -> tuple[int, int]:
    """(matched tokens, edits) of the best local alignment: 1 for a match, -penalty (in halves) for an edit."""
    unit = 1 << 20
    cost = int(penalty * 2) * unit
    slope = np.arange(len(passage) + 1) * cost
    row, best = np.zeros(len(passage) + 1, dtype=np.int64), 0
    for token in item:
        step = np.maximum(row[1:] - cost, row[:-1] + np.where(passage == token, 2 * unit + 1, -cost))
        row = np.concatenate([[0], np.maximum(step, 0)])
        row = np.maximum.accumulate(row + slope) - slope
        best = max(best, int(row.max()))
    matched = best & (unit - 1)
    return matched, (2 * matched - (best >> 20)) // int(penalty * 2)


def enough(n: int, matched: int, edits: int) -> bool:
    """Whether a passage with so many matches and edits repeats enough of an item of `n` tokens.

    An alignment ends with matches; the passage may have one edited token more at either end if its edits allow that.
    """
    outer = min(2, int(matched * EDITS / (1 - EDITS)) - edits)
    return outer >= 0 and matched + edits + outer >= PART * n and matched >= PART * n * (1 - EDITS)


def overlaps(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(key, item_key, matched, edits): each pair of a text and a test item of which it repeats enough.

    Null and empty texts and items without words match nothing; repeated texts and items each come out under their own
    ids; texts are read whole. Up to `block_tokens` test tokens (whatever public test sets have) take one pass over the
    texts. Beyond that, a first pass keeps the texts with a hit in a filter of all test windows (one pass per
    `FILTER_TOKENS`), and what is left meets one block after the other; only one index or filter is broadcast at a time.
    """
    spark = documents.sparkSession
    items = items.select(item_key, item_text).filter(F.length(item_text) > 0)
    size = items.agg(F.sum(F.regexp_count(item_text, F.lit(rf"[{HAN}]|[^\s{HAN}]+")))).first()[0] or 0
    source = spread(documents.select(key, text).filter(F.length(text) > 0), key)
    schema = f"`{key}` {dict(documents.dtypes)[key]}, `{item_key}` {dict(items.dtypes)[item_key]}, matched long, edits long"

    def shared(number: int, of: int, filter_only: bool = False):
        rows = items.filter(F.pmod(F.xxhash64(item_key), F.lit(of)) == number).orderBy(item_key).collect()
        index = Index([tuple(r) for r in rows])
        return spark.sparkContext.broadcast(index.without_items() if filter_only else index)

    def searched(rows: DataFrame, index) -> DataFrame:
        def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                keys, texts = frame[key].tolist(), frame[text].tolist()
                found = [(keys[i + d], *rest) for i in range(0, len(texts), TEXTS) for d, *rest in index.value.overlaps(texts[i : i + TEXTS])]
                yield pd.DataFrame(found, columns=[key, item_key, "matched", "edits"])

        return rows.mapInPandas(find, schema)

    def filtered(number: int, of: int) -> DataFrame:
        index = shared(number, of, filter_only=True)

        def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame[index.value.touched(frame[text].tolist())]

        return cut_lineage(source.mapInPandas(keep, source.schema))

    if size <= block_tokens:
        return searched(source, shared(0, 1))
    parts = []
    filters = math.ceil(size / FILTER_TOKENS)
    blocks = filters * math.ceil(size / filters / block_tokens)
    for f in range(filters):
        touched = filtered(f, filters)
        for b in range(f, blocks, filters):  # as filters divides blocks, these are the items of filter f
            index = shared(b, blocks)
            parts.append(cut_lineage(searched(touched, index)))
            index.unpersist()
    return reduce(DataFrame.unionByName, parts)
