from __future__ import annotations

import random

import numpy as np
import pytest

from tapeloom.llm import abuse

FINE = ["The bus to the market leaves at noon.", "We painted the old fence green.", "Der Garten ist heute sehr schön.", "今天下午我们去河边散步。", "La recette demande deux œufs.", "She read the letter twice."]
BAD = ["You are a worthless idiot.", "I will kill you and your family.", "Du bist ein dummer Idiot.", "你就是个混蛋。", "Ferme ta gueule, connard."]


@pytest.fixture(scope="module")
def classifier():
    rng = random.Random(4)
    clean = [" ".join(rng.sample(FINE, 3)) for _ in range(80)]
    marked = [" ".join([*rng.sample(FINE, 2), rng.choice(BAD)]) for _ in range(20)] + [FINE[0] + " " + FINE[1]]  # one wrong mark
    return abuse.fit(marked, clean)


def test_scores(classifier):
    scores = classifier.scores([*BAD, *FINE, "12 ...", None, "", " . "])
    assert min(scores[: len(BAD)]) > 0.5 and max(scores[len(BAD) :]) < abuse.THRESHOLD and scores[-3:] == [0.0, 0.0, 0.0]


def test_spelling_does_not_hide(classifier):
    hidden = ["you are a worthless i d i o t", "You are a worthless id*ot!", "YOU ARE A WORTHLESS IDIOOOOT", "yоu аrе а wоrthlеss idiоt", "你就是个混 蛋", "你就是个混*蛋", "you are a worthless ｉｄｉｏｔ", "you are a w0rthless 1diot"]
    assert min(classifier.scores(hidden)) > 0.5


def test_long_text_is_read_to_its_end(classifier):
    filler = " ".join(FINE) * 300
    plain_filler = filler.lower().replace(".", "")
    low, high, unpunctuated = classifier.scores([filler, filler + BAD[0], plain_filler + " you are a worthless idiot"])
    assert low < abuse.THRESHOLD < min(high, unpunctuated)


def test_batch_scores_equal_single_scores(classifier):
    texts = [*BAD, None, *FINE, "a", "。", " ".join(FINE * 9)]
    assert np.allclose(classifier.scores(texts), [classifier.scores([t])[0] for t in texts])


def test_scores_match_the_weights(classifier):
    weights = np.zeros(1 << abuse.BITS)
    weights[classifier.at] = classifier.values
    features = abuse.Features()
    for text in BAD + FINE:
        (words,) = abuse.sentences(text, classifier.known)
        codes = features.tokens(words)
        logit = classifier.intercept + sum(weights[features.grams(codes, g)].sum() for g in abuse.GRAMS)
        assert classifier.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-6)


def test_over_tables(spark):
    docs = [(i, "s1" if i % 2 else None, FINE[i % 6]) for i in range(40)] + [(100 + i, "s2", BAD[i % 5]) for i in range(10)] + [(200, "s2", None), (201, "s2", "")]
    labels = [(i, "r1", 0) for i in range(40)] + [(100 + i, "r1", 1) for i in range(10)] + [(1, "r2", 1), (2, "r2", None), (999, "r1", 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    l = spark.createDataFrame(labels, "doc_id long, reviewer string, toxic int")
    model = abuse.fit_on(d, l)
    scored = abuse.scored(d, "doc_id", "text", model, keep=("source",))
    assert {r["doc_id"] for r in scored.filter(f"score >= {abuse.THRESHOLD}").collect()} == set(range(100, 110))
    rates = {r["source"]: (r["documents"], r["abusive"]) for r in abuse.rates(scored, "source").collect()}
    assert rates == {"s1": (20, 0), None: (20, 0), "s2": (12, 10)}
    assert abuse.scored(d.limit(0), "doc_id", "text", model).count() == 0
    assert abuse.fit_on(d, l.limit(0)).scores([BAD[0]])[0] > 0.5
