"""Languages of documents and of their stretches by segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public vocabulary, fitted by expectation
maximisation on a bounded sample of labelled documents. A forward algorithm sums over all segmentations of a word (or
run of Chinese characters) into pieces, so its score depends on no single tokenisation. Whole texts are cut into
stretches by the best path over the languages with a cost for each change. A stretch's confidence is the probability, by
a logistic model fitted to held-out sentences with and without their own language among the candidates, that its language
is the right one; so text in a language that none of the distributions knows gets a low one.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import vocabularies
from tapeloom.operators.skew import spread

LANGUAGES = ("en", "zh", "de", "fr", "es", "it")
# Spellings of language labels by language, and labels that name none.
LABELS = {
    "en": "en eng english englisch anglais inglés inglese",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 普通话",
    "de": "de deu ger german deutsch allemand",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano",
}
NO_LABEL = "und unk unknown undetermined na n/a none null nil nan mul mis zxx xx other tbd"
HAN = "㐀-䶿一-鿿"
MARK = re.compile(r"(?:^|(?<=\n))[ \t]*\w{1,12}:(?=\s)")
UNIT = re.compile(rf"[{HAN}]+|[^\W\d_{HAN}]+['’]?|\d+")
SENTENCE = re.compile(r"[.!?。！？\n]+")
#: Documents per language in the sample that the distributions are fitted to.
SAMPLE_DOCS = 300
HELD = 5
#: Cost of a change of language, and the most that one word (or two Chinese characters) can say for a language.
CHANGE, MOST = 10.0, 6.0
#: Words of a long sentence.
SENTENCE_WORDS = 30
#: Words, or Chinese characters, that make a stretch.
WORDS, CHARS = 6, 12


def label_code(label: Column) -> Column:
    """Two-letter code of a label; '' if it is null, blank or names no language; 'xx' if it names another one."""
    plain = F.lower(F.trim(F.regexp_replace(label, r"(?U)\s+", " ")))
    first = F.regexp_extract(plain, r"(?U)^([^\W\d_]+)", 1)
    known = {word: code for code, words in LABELS.items() for word in words.split()}
    pairs = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    none = F.coalesce(plain, F.lit("")).isin("", *NO_LABEL.split()) | (first == "") | first.isin(*NO_LABEL.split())
    return F.when(none, "").otherwise(F.coalesce(pairs[first], F.lit("xx")))


@dataclass
class Unigrams:
    """Piece probabilities: `table` maps a piece to its probability in each language."""

    table: dict[str, np.ndarray]
    byte: list[np.ndarray]
    starts: frozenset[str]  # all beginnings of pieces, to end a look-up early
    trust: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.5, 0.5, 0.3]))  # of 1 and `evidence`

    def char(self, c: str) -> np.ndarray:
        """Probabilities of a character with no piece of its own: the product over its bytes."""
        p = np.ones(len(LANGUAGES))
        for b in c.encode("utf-8", "replace"):
            p = p * self.byte[b]
        return p

    def score(self, unit: str, han: bool) -> np.ndarray:
        """Log-probability of `unit` in each language, summed over all segmentations by the forward algorithm."""
        unit = unit if han else "▁" + unit
        n, get, starts, log = len(unit), self.table.get, self.starts, 0.0
        alpha: list = [None] * (n + 1)
        alpha[0] = np.ones(len(LANGUAGES))
        for i in range(n):
            a = alpha[i]
            if i & 7 == 7 and a.max() < 1e-100:  # against underflow in long runs
                alpha[i:] = [x if x is None else x * 1e100 for x in alpha[i:]]
                a, log = alpha[i], log - 100 * math.log(10)
            if (p := get(unit[i])) is None:
                p = self.char(unit[i])
            end = i + 1
            while p is not None or unit[i:end] in starts:
                if p is not None:
                    alpha[end] = a * p if alpha[end] is None else alpha[end] + a * p
                end += 1
                if end > n:
                    break
                p = get(unit[i:end])
        return np.log(np.maximum(alpha[n], 1e-300)) + log


class BatchScores:
    """`Unigrams.score` for many units at once: the same sums, with the steps of all units in arrays."""

    def __init__(self, model: Unigrams):
        self.model = model
        self.number = {piece: i for i, piece in enumerate(model.table)}
        # a column more: the uniform distribution, against which a language's fit is measured
        self.flat = 1.0 / (len(model.table) + 256)
        self.rows = np.column_stack([np.array(list(model.table.values())), np.full(len(model.table), self.flat)])
        self.chars: dict[str, int] = {}

    def _char(self, c: str) -> int:
        """Row of a character with no piece of its own."""
        if (at := self.chars.get(c)) is None:
            at = self.chars[c] = len(self.rows)
            self.rows = np.vstack([self.rows, np.append(self.model.char(c), self.flat ** len(c.encode("utf-8", "replace")))])
        return at

    def score(self, units: list[tuple[str, bool]]) -> np.ndarray:
        return self.with_flat(units)[:, :-1]

    def with_flat(self, units: list[tuple[str, bool]]) -> np.ndarray:
        """`score`, and in the last column that of the uniform distribution."""
        out = np.zeros((len(units), len(LANGUAGES) + 1))
        order = sorted(range(len(units)), key=lambda i: len(units[i][0]))
        for k in range(0, len(order), 2000):
            part = order[k : k + 2000]
            out[part] = self._score([units[i][0] if units[i][1] else "▁" + units[i][0] for i in part])
        return out

    def _score(self, units: list[str]) -> np.ndarray:
        get, starts = self.number.get, self.model.starts
        longest = max(map(len, units))
        steps: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in range(longest)]
        for u, unit in enumerate(units):
            n = len(unit)
            for i in range(n):
                whose, ends, rows = steps[i]
                c = unit[i]
                if (p := get(c)) is None:
                    p = self._char(c)
                end, part = i + 1, c
                while p is not None or part in starts:
                    if p is not None:
                        whose.append(u)
                        ends.append(end)
                        rows.append(p)
                    end += 1
                    if end > n:
                        break
                    part = unit[i:end]
                    p = get(part)
        alpha = np.zeros((len(units), longest + 1, len(LANGUAGES) + 1))
        alpha[:, 0] = 1.0
        log = np.zeros(len(units))
        for i, (whose, ends, rows) in enumerate(steps):
            if i & 7 == 7:  # against underflow in long runs
                low = np.flatnonzero((alpha[:, i].max(axis=1) < 1e-100) & (alpha[:, i].max(axis=1) > 0))
                alpha[low, i:] *= 1e100
                log[low] -= 100 * math.log(10)
            if whose:
                u = np.array(whose)
                alpha[u, np.array(ends)] += alpha[u, i] * self.rows[rows]
        last = alpha[np.arange(len(units)), [len(x) for x in units]]
        return np.log(np.maximum(last, 1e-300)) + log[:, None]


def unmarked(text: str) -> str:
    """`text` with blanks for its speaker marks."""
    return MARK.sub(lambda m: " " * len(m.group()), text) if ":" in text else text


def is_han(unit: str) -> bool:
    return "㐀" <= unit[0] <= "䶿" or "一" <= unit[0] <= "鿿"


def units_of(text: str) -> list[tuple[str, bool]]:
    """A text's words and Chinese runs in lower case, and whether they are Chinese; no numbers and speaker marks."""
    return [(u.lower(), is_han(u)) for u in UNIT.findall(unmarked(text)) if not u.isdecimal()]


def _expected(table: dict[str, float], byte: list[float], starts: frozenset[str], unit: str, times: float, into: dict) -> None:
    """Adds the expected piece counts of `unit` in one language to `into` (forward-backward)."""
    n, get = len(unit), table.get
    arcs: list[list[tuple[int, float, str | None]]] = []
    for i in range(n):
        own, end, p = [], i + 1, get(unit[i])
        if p is None:
            own.append((end, math.prod(byte[b] for b in unit[i].encode("utf-8", "replace")), None))
        while p is not None or unit[i:end] in starts:
            if p is not None:
                own.append((end, p, unit[i:end]))
            end += 1
            if end > n:
                break
            p = get(unit[i:end])
        arcs.append(own)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    alpha[0] = beta[n] = 1.0
    for i in range(n):
        if a := alpha[i]:
            for end, p, _ in arcs[i]:
                alpha[end] += a * p
    if alpha[n] <= 0:
        return
    for i in range(n - 1, -1, -1):
        for end, p, _ in arcs[i]:
            beta[i] += p * beta[end]
    for i in range(n):
        if a := alpha[i] * times / alpha[n]:
            for end, p, piece in arcs[i]:
                if piece is not None:
                    into[piece] += a * p * beta[end]
                else:
                    for b in unit[i].encode("utf-8", "replace"):
                        into[b] += a * p * beta[end]


def _uniform(pieces: Iterable[str]) -> Unigrams:
    words = {p for p in pieces if p == p.lower() and not re.fullmatch(r"<.*>", p)}
    flat = np.full(len(LANGUAGES), 1.0 / (len(words) + 256))
    return Unigrams(dict.fromkeys(words, flat), [flat] * 256, frozenset(p[:k] for p in words for k in range(1, len(p))))


def _estimate(model: Unigrams, counts: list[Counter], strength: float = 1000.0) -> Unigrams:
    """One round: expected counts by language, smoothed towards the pooled counts and the uniform distribution."""
    found: list[dict] = []
    for at, units in enumerate(counts):
        into: dict = defaultdict(float)
        table, byte = {p: float(v[at]) for p, v in model.table.items()}, [float(v[at]) for v in model.byte]
        for (unit, han), times in units.items():
            whole = unit if han else "▁" + unit
            for k in range(0, len(whole), 30):  # long runs in parts, against underflow
                _expected(table, byte, model.starts, whole[k : k + 30], times, into)
        found.append(into)
    totals = np.array([sum(x.values()) for x in found])
    share = np.maximum(totals, 1.0)
    flat = 1.0 / (len(model.table) + 256)

    def smoothed(piece) -> np.ndarray:
        own = np.array([x.get(piece, 0.0) for x in found])
        pooled = (own / share).mean()
        return (own + strength * (0.5 * pooled + 0.5 * flat)) / (totals + strength)

    seen = set().union(*found)
    rest = (strength * 0.5 * flat) / (totals + strength)
    return Unigrams({p: smoothed(p) if p in seen else rest for p in model.table}, [smoothed(b) if b in seen else rest for b in range(256)], model.starts)


def fit(texts: Iterable[tuple[str, str]], pieces: Iterable[str], rounds: int = 2) -> Unigrams:
    """Distributions fitted to (language, text) pairs, of which some may be labelled wrong or be mixed.

    A first fit uses all sentences but every `HELD`th; a second one those of them that the first gives the language of
    their label. The sentences held out serve the model of confidence.
    """
    sentences = []
    for lang, text in texts:
        if lang in LANGUAGES:
            for part in SENTENCE.split(text or ""):
                if units := units_of(part):
                    sentences.append((LANGUAGES.index(lang), units))
    model = _uniform(pieces)
    held, sentences = sentences[::HELD], [x for i, x in enumerate(sentences) if i % HELD] or sentences
    for again in (False, True):
        if again:
            scorer = Scorer(model)
            scorer.learn(u for _, units in sentences for u in units)
            sentences = [(at, units) for at, units in sentences if int(np.argmax(sum(scorer.unit(*u) for u in units))) == at]
        counts = [Counter() for _ in LANGUAGES]
        for at, units in sentences:
            counts[at].update(units)
        for _ in range(1 if again else rounds):
            model = _estimate(model, counts)
    return _trusted(model, held)


def evidence(total: np.ndarray, at: int, others: np.ndarray) -> tuple[float, float, float]:
    """What confidence rests on: fit per word against the uniform distribution, lead over other languages, log size.

    `total` is a sum of rows of `Scorer.table`, `others` has the totals of the other languages.
    """
    words = max(1.0, total[-2] + total[-1] / 2)
    size = min(words, SENTENCE_WORDS)  # a longer text isn't surer than a long sentence, on which the weights rest
    return (total[-3] + total[at]) / words, (total[at] - others.max()) / words * math.sqrt(size), math.log(size)


def _trusted(model: Unigrams, held: list[tuple[int, list[tuple[str, bool]]]]) -> Unigrams:
    """`model` with its logistic model of confidence, fitted to sentences that took no part in the distributions.

    Each sentence counts twice: as it is, where its label should win, and without its own language, where whatever wins is
    wrong; and so do its first words.
    """
    scorer = Scorer(model)
    scorer.learn(u for _, units in held for u in units)
    rows, right = [], []
    for at, units in held:
        for part in (units, units[:3]):
            total = sum((scorer.row(*u) for u in part), np.zeros(scorer.table.shape[1]))
            said = total[: len(LANGUAGES)]
            if part and said.argmax() == at:
                rest = np.delete(said, at)
                wrong = int(np.where(np.arange(len(said)) == at, -np.inf, said).argmax())
                rows += [evidence(total, at, rest), evidence(total, wrong, np.delete(said, [at, wrong]))]
                right += [1.0, 0.0]
    if not rows:
        return model
    x, y = np.column_stack([np.ones(len(rows)), np.array(rows)]), np.array(right)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
    return replace(model, trust=w)


class Scorer:
    """Scores of units relative to the best language, kept for reuse, and the stretches of whole texts."""

    def __init__(self, model: Unigrams, keep: int = 300_000):
        self.batch, self.keep = BatchScores(model), keep
        # A row per unit: its scores relative to the best language, the best one's lead over the uniform distribution, the
        # words and the Chinese characters it counts for. Row 0 is that of any number.
        self.trust = model.trust.tolist()
        self.table = np.zeros((1 << 12, len(LANGUAGES) + 3))
        self.table[0, -2] = 1
        self.known: dict[str, int] = {}
        self.written: dict[str, int] = {}  # rows by unit as it is written
        self.passing: dict[str, int] = {}  # long runs, whose rows are kept for the texts at hand only

    def learn(self, units: Iterable[tuple[str, bool]]) -> None:
        """Scores the units that are not known yet, all at once, relative to their best language and down to a floor."""
        self.passing.clear()
        if len(self.known) > self.keep:
            self.known.clear()
            self.written.clear()
        new = [u for u in dict.fromkeys(units) if u[0] not in self.known]
        if not new:
            return
        new.sort(key=lambda u: u[1] and len(u[0]) > 12)  # the long runs last
        scores = self.batch.with_flat(new)
        top, flat = scores[:, :-1].max(axis=1), scores[:, -1]
        scores = scores[:, :-1] - top[:, None]
        most = [MOST * (max(1.0, len(u) / 2) if han else 1.0) for u, han in new]
        first = len(self.known) + 1
        if first + len(new) > len(self.table):
            self.table = np.vstack([self.table, np.zeros((first + len(new), self.table.shape[1]))])
        rows = self.table[first : first + len(new)]
        rows[:, :-3] = np.maximum(scores, -np.array(most)[:, None])
        rows[:, -3] = np.clip(top - flat, -np.array(most), 2 * np.array(most))
        rows[:, -2] = [not han and u[-1] not in "'’" for u, han in new]
        rows[:, -1] = [len(u) if han else 0 for u, han in new]
        for at, (unit, han) in enumerate(new, first):
            (self.passing if han and len(unit) > 12 else self.known)[unit] = at

    def row(self, unit: str, han: bool) -> np.ndarray:
        """The row of a unit."""
        if (at := self.known.get(unit)) is None and (at := self.passing.get(unit)) is None:
            self.learn([(unit, han)])
            return self.row(unit, han)
        return self.table[at]

    def unit(self, unit: str, han: bool) -> np.ndarray:
        """Scores of a unit."""
        return self.row(unit, han)[: len(LANGUAGES)]

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each unit on the best path."""
        total = scores.sum(axis=0)
        best = int(total.argmax())
        gain = np.cumsum(scores - scores[:, [best]], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain]), axis=0)[:-1]
        if (gain - low).max() < CHANGE / 2:
            return np.full(len(scores), best)
        rows, n = scores.tolist(), len(scores)
        value, back = rows[0], []
        for row in rows[1:]:
            top = max(value)
            at = value.index(top)
            change = top - CHANGE
            back.append([k if v >= change else at for k, v in enumerate(value)])
            value = [max(v, change) + s for v, s in zip(value, row)]
        state = value.index(max(value))
        states = [state]
        for i in reversed(range(n - 1)):
            state = back[i][state]
            states.append(state)
        return np.array(states[::-1])

    def all_stretches(self, texts: list[str | None], together: int = 200) -> Iterator[list]:
        """`stretches` of each text, the units of `together` texts being scored at once."""
        for k in range(0, len(texts), together):
            plain = [unmarked(t) if t else "" for t in texts[k : k + together]]
            said = [UNIT.findall(t) for t in plain]
            if max(len(self.known), len(self.written) // 2) > self.keep:
                self.known.clear()
                self.written.clear()
            new = dict.fromkeys(u for own in said for u in own if u not in self.written)
            self.learn((u.lower(), is_han(u)) for u in new if not u.isdecimal())
            for u in new:
                low = u.lower()
                self.written[u] = 0 if u.isdecimal() else self.known.get(low) or self.passing[low]
            for text, own in zip(plain, said):
                rows = np.array([self.written[u] for u in own], dtype=int)
                yield self._stretches(text, own, rows) if rows.any() else []
            for u in new:  # what was learned for these texts only
                if u.lower() in self.passing:
                    del self.written[u]

    def stretches(self, text: str | None) -> list[tuple[int, int, str, float, int, bool]]:
        """(start, end, language, confidence, words or Chinese characters, long enough) of each stretch, in order."""
        return next(self.all_stretches([text]))

    def _stretches(self, text: str, units: list[str], rows: np.ndarray) -> list[tuple[int, int, str, float, int, bool]]:
        values = self.table[rows]
        states = self.path(values[:, : len(LANGUAGES)])
        cuts = [0, *(np.flatnonzero(np.diff(states)) + 1).tolist(), len(units)]
        if len(cuts) > 2:
            spans = [m.span() for m in UNIT.finditer(text)]
        else:  # no letter or digit follows the last unit
            end = text.rfind(units[-1]) + len(units[-1])
            spans = {len(units) - 1: (0, end), 0: (UNIT.search(text).start(), end)}
        out = []
        for a, b in zip(cuts, cuts[1:]):
            at = int(states[a])
            total = values[a:b].sum(axis=0)
            size, least = (int(total[-1]), CHARS) if LANGUAGES[at] == "zh" else (int(total[-2]), WORDS)
            fit, lead, words = evidence(total, at, np.delete(total[: len(LANGUAGES)], at))
            z = self.trust[0] + self.trust[1] * fit + self.trust[2] * lead + self.trust[3] * words
            out.append((spans[a][0], spans[b - 1][1], LANGUAGES[at], 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), size, size >= least))
        return out


STRETCHES = "seg_no long, start_char long, end_char long, lang_code string, confidence double, n_words long, long_enough boolean"


def fit_on(documents: DataFrame, text: str, label: str, key: str, sample_docs: int = SAMPLE_DOCS, folder: str = vocabularies.FOLDER) -> Unigrams:
    """Distributions fitted to about `sample_docs` labelled documents a language (fewer where there are fewer).

    The sample is the documents whose key hashes below a bound that follows from the label's count.
    """
    labelled = documents.select(label_code(F.col(label)).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h")).filter(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    bound = F.create_map(*(F.lit(x) for lang, n in {"": 1, **counts}.items() for x in (lang, min(1.0, sample_docs / n))))
    sample = labelled.filter(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < bound[F.col("lang")]).select("lang", "text").collect()
    return fit(((r["lang"], r["text"]) for r in sample), vocabularies.pieces(folder))


def stretches(documents: DataFrame, key: str, text: str, model: Unigrams) -> DataFrame:
    """(key, seg_no, start_char, end_char, lang_code, confidence, n_words, long_enough), one row per stretch.

    Texts are read whole. A text that is null, blank or without words gives one row with a null language and
    confidence 0, so every document comes out. Numbers belong to the stretch around them; speaker marks to none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)[key]

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for frame in frames:
            rows = []
            texts = [t if isinstance(t, str) else None for t in frame[text]]
            for k, found in zip(frame[key], scorer.all_stretches(texts)):
                rows += [(k, i, *s) for i, s in enumerate(found)] or [(k, 0, None, None, None, 0.0, 0, False)]
            yield pd.DataFrame(rows, columns=[key, "seg_no", "start_char", "end_char", "lang_code", "confidence", "n_words", "long_enough"])

    return spread(documents.select(key, text), key).mapInPandas(mark, f"`{key}` {kind}, {STRETCHES}")


def by_document(marked: DataFrame, key: str) -> DataFrame:
    """(key, lang_code, confidence, n_languages, n_stretches): the language with most text, and how many there are.

    Confidence is the mean over that language's stretches, weighted by words, times its share of the words. Ties
    go to the smaller code.
    """
    per = marked.groupBy(key, "lang_code").agg(
        F.sum("n_words").alias("n"), F.sum(F.col("confidence") * F.col("n_words")).alias("c"), F.max(F.col("long_enough").cast("int")).alias("e"), F.count("lang_code").alias("k")
    )
    most = F.min_by(F.struct("lang_code", "c"), F.struct((-F.col("n")).alias("n"), F.col("lang_code")))
    docs = per.groupBy(key).agg(most.alias("m"), F.sum("n").alias("all"), F.sum("e").alias("n_languages"), F.sum("k").alias("n_stretches"))
    return docs.select(key, "m.lang_code", F.coalesce(F.try_divide(F.col("m.c"), F.col("all")), F.lit(0.0)).alias("confidence"), "n_languages", "n_stretches")


def found(documents: DataFrame, marked: DataFrame, key: str, label: str) -> DataFrame:
    """(key, lang_code) of documents whose label is missing or wrong, or that hold several languages."""
    langs = marked.filter("long_enough").groupBy(key).agg(F.collect_set("lang_code").alias("langs"))
    both = documents.select(key, label_code(F.col(label)).alias("said")).join(langs, key)
    case = (F.size("langs") > 1) | (F.col("said") == "") | ~F.array_contains("langs", F.col("said"))
    return both.filter(case).select(key, F.explode("langs").alias("lang_code"))
