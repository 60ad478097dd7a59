"""Abuse scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Text is brought to one form (look-alikes, case, accents, masked and spaced letters), cut into sentences or windows, and
each is scored by the sum of the weights of its hashed n-grams and skip-grams; a document scores as its worst sentence.
The weights are learned from hand-written examples and a bounded sample of the reviewed documents. As reviewers mark
whole documents, the fit has to find the offending sentences: see `fit`.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import abuse_examples, lookalikes
from tapeloom.operators.skew import spread

HAN = "㐀-䶿一-鿿"
MARKS = r"*@$!#%&+_.\-·•|^~"
#: log2 of the number of weights, and (mask, span) of the n-grams and skip-grams: positions used from the first token.
BITS = 22
GRAMS = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3), (0, 2), (0, 3))
#: Most reviewed documents used for fitting, marked and unmarked.
MOST_MARKED, MOST_UNMARKED = 2000, 6000
#: A sentence with more tokens is scored in windows of this many tokens, half overlapping.
WINDOW = 18
THRESHOLD = 0.4
#: Probability, under chance, of a feature that is taken as evidence, and such features in an abusive sentence.
CHANCE, EVIDENT = 1e-5, 3
#: Where nothing else explains a marked text, its worst sentence counts with at least this logit and margin to the next,
#: and if at most this share of harmless sentences in marked texts gets as high a logit.
LEAST, MARGIN, RARE = -2.0, 1.0, 0.005
#: Examples in one step of the fit.
BATCH = 128
# Letters that digits and signs stand for.
LEET = str.maketrans("013457@$", "oieastas")
END = re.compile(r"[.!?;。！？；\n\r]+(?=\s|[^\w\s]|[" + HAN + r"]|$)|\n+")
WORD = re.compile(rf"[{HAN}]|[^\W_{HAN}](?:[^\W_{HAN}]|[{MARKS}]+(?=[^\W_{HAN}]))*")
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W\d_{HAN}][\s{MARKS}]{{1,2}}){{3,}}[^\W\d_{HAN}](?![^\W_])")
INSIDE_HAN = re.compile(rf"(?<=[{HAN}])[\s{MARKS}]{{1,2}}(?=[{HAN}])")
LONG_RUN = re.compile(r"(\w)\1{2,}")


def plain(text: str) -> str:
    """`text` with look-alikes made ordinary, in lower case and without accents."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", lookalikes.canonical(text)))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.casefold()


def _letters(word: str, known: dict[str, str]) -> str:
    """A word as letters: masked letters resolved by the words in `known`, digits and signs read as letters."""
    if word.isalpha():
        return LONG_RUN.sub(r"\1", word) if LONG_RUN.search(word) else word
    if word.isdigit():
        return "0"
    bare = re.sub(rf"[{MARKS}]+", "", word)
    hidden = re.sub(rf"[{MARKS}\d]", "?", word)
    for form in (bare, word.translate(LEET), hidden):
        if form in known:
            return known[form]
    read = re.sub(rf"[{MARKS}]+", "", word.translate(LEET) if any(c.isalpha() for c in word) else word)
    return read if read.isalpha() else "0"


def sentences(text: str, known: dict[str, str]) -> list[list[str]]:
    """The tokens of each sentence; long sentences come as half-overlapping windows."""
    out = []
    text = SPACED.sub(lambda m: re.sub(rf"[\s{MARKS}]+", "", m.group()), plain(text))
    for part in END.split(text):
        part = INSIDE_HAN.sub("", part)
        words = [w if len(w) == 1 else _letters(w, known) for w in WORD.findall(part)]
        if words:
            size = WINDOW if sum(len(w) > 1 for w in words) > len(words) / 3 else 2 * WINDOW
            if len(words) <= size * 3 // 2:
                out.append(words)
            else:
                out += [words[i : i + size] for i in range(0, len(words) - size // 2, size // 2)]
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; faster here than `np.unique`."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Features:
    """Hashed features of token lists."""

    def __init__(self):
        self.codes: dict[str, int] = {}

    def code(self, word: str) -> int:
        if (c := self.codes.get(word)) is None:
            if len(self.codes) > 500_000:
                self.codes.clear()
            c = self.codes[word] = zlib.crc32(word.encode("utf-8", "replace")) | 1 << 32
        return c

    def tokens(self, words: list[str]) -> np.ndarray:
        return np.array([self.code(w) for w in words], dtype=np.uint64)

    @staticmethod
    def grams(codes: np.ndarray, gram: tuple[int, ...]) -> np.ndarray:
        """Feature numbers of one kind of gram at each position where it fits."""
        n = len(codes) - gram[-1]
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        h = np.full(n, 0x9E3779B97F4A7C15 * (1 + sum((k + 1) * 31**j for j, k in enumerate(gram))) & (1 << 64) - 1, dtype=np.uint64)
        for k in gram:
            h = (h ^ codes[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    def all(self, parts: list[list[str]]) -> list[np.ndarray]:
        """The distinct features of each token list."""
        if not parts:
            return []
        sizes = np.array([len(p) for p in parts])
        codes, owner = self.tokens([w for p in parts for w in p]), np.repeat(np.arange(len(parts)), sizes)
        found = []
        for gram in GRAMS:
            n = max(0, len(codes) - gram[-1])
            inside = np.flatnonzero(owner[:n] == owner[len(owner) - n :])
            found.append(owner[inside] << BITS | self.grams(codes, gram)[inside])
        each = distinct(np.concatenate(found))
        return np.split(each & (1 << BITS) - 1, np.searchsorted(each, np.arange(1, len(parts)) << BITS))


class Ftrl:
    """FTRL-proximal logistic regression with per-coordinate rates and a fixed intercept; L1 keeps `weights` sparse."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.4, l2: float = 1.0, intercept: float = -3.0):
        self.alpha, self.beta, self.l1, self.l2, self.intercept = alpha, beta, l1, l2, intercept
        self.z, self.n, self.sums = np.zeros(size), np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def logits(self, examples: list[np.ndarray]) -> np.ndarray:
        """The logit of each feature list."""
        if not examples:
            return np.empty(0)
        owner = np.repeat(np.arange(len(examples)), [len(x) for x in examples])
        return np.bincount(owner, self.weights()[np.concatenate(examples)], len(examples)) + self.intercept

    def learn(self, examples: list[np.ndarray], y: np.ndarray, times: np.ndarray) -> None:
        """One step on a small batch: the gradients of its examples, weighted by `times`, are added up per coordinate."""
        owner, at = np.repeat(np.arange(len(examples)), [len(x) for x in examples]), np.concatenate(examples)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w, len(examples)) + self.intercept, -35, 35)))
        self.sums[at] = 0.0
        np.add.at(self.sums, at, (times * (p - y))[owner])
        g, n = self.sums[at], self.n[at]  # a coordinate that occurs twice gets the same new values twice
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _masked_forms(words: Iterable[str]) -> dict[str, str]:
    """Forms of each word with one letter or two neighbouring ones hidden or one left out, and the word itself."""
    out: dict[str, str] = {}
    for w in sorted(set(words)):
        if len(w) >= 4 and w.isalpha() and w.isascii():
            for i in range(len(w)):
                out.setdefault(w[:i] + "?" + w[i + 1 :], w)
                if i + 1 < len(w):
                    out.setdefault(w[:i] + "??" + w[i + 2 :], w)
                if len(w) >= 5 and 0 < i < len(w) - 1:
                    out.setdefault(w[:i] + w[i + 1 :], w)
    return out | {w: w for w in words}


class Classifier:
    """Compact, broadcastable weights: numbers and values of the non-zero ones, the intercept, and masked words."""

    def __init__(self, model: Ftrl, numbers: np.ndarray, known: dict[str, str]):
        w = model.weights()
        some = np.flatnonzero(w)
        self.at, self.values = numbers[some].astype(np.int32), w[some].astype(np.float32)
        self.intercept, self.known = model.intercept, known
        self.features, self.dense = Features(), None

    def __getstate__(self):
        return self.__dict__ | {"features": None, "dense": None}

    def scores(self, texts: list[str | None]) -> list[float]:
        """The probability of the worst sentence of each text; 0 for null and texts without words."""
        if self.dense is None:
            self.features, self.dense = Features(), np.zeros(1 << BITS, dtype=np.float32)
            self.dense[self.at] = self.values
        parts, owner = [], []
        for i, text in enumerate(texts):
            own = sentences(text, self.known) if isinstance(text, str) else []
            parts += own
            owner += [i] * len(own)
        out = np.zeros(len(texts))
        if not parts:
            return out.tolist()
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        codes = self.features.tokens([w for p in parts for w in p])
        total = np.full(len(parts), self.intercept)
        for gram in GRAMS:
            run = np.concatenate([[0.0], np.cumsum(self.dense[self.features.grams(codes, gram)])])
            last = np.minimum(np.maximum(ends - gram[-1], ends - sizes), len(run) - 1)
            total += run[last] - run[np.minimum(ends - sizes, len(run) - 1)]
        np.maximum.at(out, np.array(owner), 1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return out.tolist()


def _evident(docs: list[np.ndarray], others: list[np.ndarray], size: int) -> np.ndarray:
    """Features that stand in marked documents too often for chance (a Chernoff bound under `CHANCE`) and hardly in others.

    Documents come as their distinct features; copies of a document count once.
    """
    own = [list({x.tobytes(): x for x in many}.values()) for many in (docs, others)]
    inside, outside = (np.bincount(np.concatenate(many), minlength=size) if many else np.zeros(size) for many in own)
    share = (len(docs) + 0.5) / (len(docs) + len(others) + 1)
    part = inside / np.maximum(inside + outside, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = inside * np.log(part / share) + np.where(outside > 0, outside * np.log((1 - part) / (1 - share)), 0.0)
    return (inside >= 3) & (part > share) & (surprise > -math.log(CHANCE)) & (outside * len(docs) * 20 <= inside * max(1, len(others)))


def fit(marked: Iterable[str], unmarked: Iterable[str], rounds: int = 3, seed: int = 7) -> Classifier:
    """A classifier from texts that reviewers marked as abusive and texts they did not; a few marks may be wrong.

    A marked text says only that some sentence of it is abusive. Taken as abusive are sentences that the hand-written
    examples lead to, that hold `EVIDENT` evident features (see `_evident`; a single one may be a clash of hashes) of the
    texts not explained so far, or that the model of the other half of the marked texts finds abusive; a text with none of
    these teaches nothing. The other sentences of a text whose abusive one is found are
    counter-examples, like all sentences of unmarked texts but those on which both models are all but sure.
    """
    features = Features()
    abusive = abuse_examples.ABUSIVE.splitlines() + re.split(r",\s*|\n", abuse_examples.INSULTS)
    own_words = [w for line in abusive for s in sentences(line, {}) for w in s]
    harmless_words = {w for line in abuse_examples.HARMLESS.splitlines() for s in sentences(line, {}) for w in s}
    known = _masked_forms(w for w in own_words if w not in harmless_words)
    texts = [abusive, abuse_examples.HARMLESS.splitlines(), list(marked), list(unmarked)]
    parts = [[x for t in many if t and (x := sentences(t, known))] for many in texts]
    read = features.all([s for many in parts for doc in many for s in doc])
    numbers, flat_numbers = np.unique(np.concatenate(read), return_inverse=True)
    read = iter(np.split(flat_numbers, np.cumsum([len(s) for s in read])[:-1]))
    bad, fine, docs, others = [[[next(read) for _ in doc] for doc in many] for many in parts]
    bad, fine = ([s for doc in many for s in doc] for many in (bad, fine))
    in_docs, in_others = ([distinct(np.concatenate(doc)) for doc in many] for many in (docs, others))
    common = {s.tobytes(): s for doc in others for s in doc}
    rng = np.random.default_rng(seed)

    def train(positive: list[np.ndarray], negative: list[np.ndarray], epochs: int) -> Ftrl:
        examples = bad + positive + fine + negative
        y = np.arange(len(examples)) < len(bad) + len(positive)
        times = np.where(y, max(1.0, min(4.0, math.sqrt(len(examples) / y.sum()))), 1.0)
        model = Ftrl(len(numbers))
        for _ in range(epochs):
            order = rng.permutation(len(examples))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                model.learn([examples[k] for k in part], y[part], times[part])
        return model

    flat = [s for doc in docs for s in doc]
    owner = np.array([i for i, doc in enumerate(docs) for _ in doc], dtype=int)
    half, each = owner % 2, np.arange(len(owner))
    clear = np.array([s.tobytes() not in common for s in flat], dtype=bool)
    pick = lambda which: [flat[i] for i in np.flatnonzero(which)]
    chosen = clear & (train([], list(common.values()), 1).logits(flat) > 0)
    unlikely = ~chosen
    doubtful: set[bytes] = set()
    for number in range(rounds):
        while True:  # what is evident among the texts that are still unexplained
            explained = np.isin(np.arange(len(docs)), owner[chosen])
            evident = _evident([x for x, known_ in zip(in_docs, explained) if not known_], in_others, len(numbers))
            more = ~chosen & np.array([evident[s].sum() >= EVIDENT for s in flat], dtype=bool)
            if not more.any():
                break
            chosen |= more
            doubtful |= {k for k, s in common.items() if evident[s].sum() >= EVIDENT}
        explained = np.isin(owner, owner[chosen])
        negative = [s for k, s in common.items() if k not in doubtful] + pick(explained & ~chosen & unlikely)
        if number + 1 == rounds:
            break
        judges = [train(pick(chosen & (half == k)), negative, 1) for k in (0, 1)]
        # a half is judged by the model of the other one, which has not seen its sentences
        unseen = np.array([j.logits(flat) for j in judges]).reshape(2, -1)[1 - half, each]
        top = np.full(len(docs), -np.inf)
        np.maximum.at(top, owner, unseen)
        second = np.full(len(docs), -np.inf)
        np.maximum.at(second, owner, np.where(unseen < top[owner], unseen, -np.inf))
        # the logits that harmless sentences of marked texts reach: the other sentences where the abusive one is known
        usual = np.sort(unseen[explained & ~chosen])
        bar = usual[int(len(usual) * (1 - RARE))] if len(usual) * RARE >= 1 else LEAST
        stands_out = (unseen == top[owner]) & (unseen > max(LEAST, bar)) & (unseen - second[owner] > MARGIN)
        chosen |= clear & ((unseen > max(0.0, bar)) | stands_out)
        unlikely = unseen < -1
        # sentences that are all but sure stand in documents that a reviewer failed to mark
        sure = np.min([j.logits(list(common.values())) for j in judges], axis=0) > 3.0
        doubtful |= {k for k, x in zip(common, sure) if x}
    return Classifier(train(pick(chosen), negative, 3), numbers, known)


def fit_on(documents: DataFrame, labels: DataFrame, most_marked: int = MOST_MARKED, most_unmarked: int = MOST_UNMARKED) -> Classifier:
    """A classifier fitted to at most about `most_marked` and `most_unmarked` reviewed documents, chosen by a hash of the id.

    A document's mark is the majority of its reviewers'; ties and nulls are left out.
    """
    votes = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.avg("toxic").alias("share")).filter("share != 0.5")
    votes = votes.select("doc_id", (F.col("share") > 0.5).alias("marked"), F.xxhash64("doc_id").alias("h"))
    counts = {r["marked"]: r["count"] for r in votes.groupBy("marked").count().collect()}
    bound = {m: min(1.0, most / counts[m]) if m in counts else 0.0 for m, most in ((True, most_marked), (False, most_unmarked))}
    share = F.when(F.col("marked"), bound[True]).otherwise(bound[False])
    chosen = votes.filter(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < share)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()
    return fit([r["text"] for r in rows if r["marked"]], [r["text"] for r in rows if not r["marked"]])


def scored(documents: DataFrame, key: str, text: str, classifier: Classifier, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, score): the score of each document, whole texts read; null and blank texts score 0."""
    shared = documents.sparkSession.sparkContext.broadcast(classifier)
    kinds = dict(documents.dtypes)

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores: list[float] = []
            for i in range(0, len(frame), 500):
                scores += shared.value.scores(frame[text].iloc[i : i + 500].tolist())
            yield frame[[key, *keep]].assign(score=scores)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", score double"
    return spread(documents.select(key, *keep, text), key).mapInPandas(mark, schema)


def rates(scores: DataFrame, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, abusive, rate, mean_score) of each source; a null source is a source of its own."""
    return scores.groupBy(source).agg(
        F.count("*").alias("documents"), F.sum((F.col("score") >= threshold).cast("long")).alias("abusive"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
