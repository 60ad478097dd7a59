from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import languages, vocabularies

PIECES = ["▁a", "▁ab", "b", "a", "ba", "c", "▁", "中", "文", "中文"]
TEXTS = {
    "en": "The old clock stopped at noon and nobody in the village knew why. We walked along the river with our friends. ",
    "de": "Die alte Uhr blieb am Mittag stehen und niemand im Dorf wusste warum. Wir gingen mit unseren Freunden am Fluss entlang. ",
    "fr": "La vieille horloge s'est arrêtée à midi et personne dans le village ne savait pourquoi. Nous avons marché avec nos amis. ",
    "es": "El viejo reloj se paró al mediodía y nadie en el pueblo sabía por qué. Caminamos por el río con nuestros amigos. ",
    "it": "Il vecchio orologio si fermò a mezzogiorno e nessuno nel paese sapeva perché. Abbiamo camminato lungo il fiume. ",
    "zh": "村里的旧钟在中午停了，没有人知道为什么。我们和朋友们沿着河边走了很久。",
}


@pytest.fixture(scope="module")
def model():
    return languages.fit([(k, v) for k, v in TEXTS.items() for _ in range(4)], vocabularies.pieces())


def test_forward_sums_all_segmentations():
    model = languages._uniform(PIECES)
    p = {w: model.table[w][0] for w in model.table}
    for unit, han in (("aba", False), ("abab", False), ("中文中", True)):
        whole = unit if han else "▁" + unit
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(whole) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(whole[last:i])
                    last = i
            parts.append(whole[last:])
            if all(w in p for w in parts):
                total += math.prod(p[w] for w in parts)
        assert model.score(unit, han)[0] == pytest.approx(math.log(total))
    long = model.score("中文" * 500, True)
    assert np.isfinite(long).all() and long[0] < -1000


def test_batch_scores_equal_single_ones(model):
    units = [("village", False), ("河边走了很久", True), ("ŋ☃x", False), ("q" * 80, False), ("中文龘" * 60, True), ("a", False)]
    assert np.allclose(languages.BatchScores(model).score(units), [model.score(*u) for u in units])


def test_stretches(model):
    scorer = languages.Scorer(model)
    for lang, text in TEXTS.items():
        (only,) = scorer.stretches(text)
        assert only[2] == lang and only[5] and only[3] > 0.5
    mixed = scorer.stretches(TEXTS["en"] + TEXTS["zh"] + TEXTS["de"])
    assert [s[2] for s in mixed] == ["en", "zh", "de"]
    assert [s[2] for s in scorer.stretches(TEXTS["de"] + " weekend " + TEXTS["de"])] == ["de"]
    assert scorer.stretches(None) == scorer.stretches("  12 ") == scorer.stretches("") == []
    assert not scorer.stretches("The old clock stopped.")[0][5]


def test_labels(spark):
    values = ["EN", "en_GB", "English", "zho", "zh-CN", "nl", "und", "", None, "??", " N/A ", "Deutsch"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(languages.label_code(F.col("v"))).collect()] == ["en", "en", "en", "zh", "zh", "xx", "", "", "", "", "", "de"]


def test_found(spark):
    rows = [(1, TEXTS["en"], "en"), (2, TEXTS["en"], "fr"), (3, TEXTS["zh"], None), (4, TEXTS["en"] + TEXTS["zh"], "en"), (5, None, None), (6, "Hi.", None), (7, "", "und"), (8, TEXTS["de"] * 300, "nl"), (9, TEXTS["it"], "ita"), (10, TEXTS["es"], "es"), (11, TEXTS["fr"], "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    base = spark.createDataFrame([(i, t * 20, k) for i, (k, t) in enumerate(TEXTS.items())], "doc_id long, text string, lang string")
    model = languages.fit_on(base, "text", "lang", "doc_id")
    marked = languages.stretches(df, "doc_id", "text", model)
    got = sorted(map(tuple, languages.found(df, marked, "doc_id", "lang").collect()))
    assert got == [(2, "en"), (3, "zh"), (4, "en"), (4, "zh"), (8, "de")]
    docs = {r["doc_id"]: r for r in languages.by_document(marked, "doc_id").collect()}
    assert len(docs) == len(rows) and docs[5]["lang_code"] is None and docs[5]["confidence"] == 0.0 and docs[4]["n_languages"] == 2
    assert languages.stretches(df.limit(0), "doc_id", "text", model).count() == 0


def test_confidence_is_low_for_unknown_languages(spark, data):
    model = languages.fit_on(spark.read.parquet(f"{data}/documents.parquet"), "text", "lang", "doc_id")
    scorer = languages.Scorer(model)
    for lang in ("en", "de", "zh"):
        assert scorer.stretches(TEXTS[lang] * 200)[0][2] == lang and scorer.stretches(TEXTS[lang] * 200)[0][3] > 0.5
    unknown = ["Поезд отправляется завтра утром в девять часов", "asdf jkl qwer zxcv uiop hjkl fghj dfgh", "これはにほんごのぶんしょうです", "Pociąg odjeżdża jutro o dziewiątej rano"]
    assert max(s[3] for text in unknown for s in scorer.stretches(text)) < 0.5
