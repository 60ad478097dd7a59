from __future__ import annotations

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import lookalikes

CASES = {
    "ｆｕｌｌ　１２": "full 12",
    "e\u0301te\u0301": "été",
    "zero\u200bwidth\ufeff": "zerowidth",
    "no\u00a0break": "no break",
    "раyраl": "paypal",
    "Саn уоu": "Can you",
    "ﬁne ⼯": "fine 工",
    "K\u212b": "K\u00c5",
    "so\u00adft": "soft",
}
ORDINARY = ["", "plain", "中文，标点！“引号”", "é ß ñ", "хорошо", "λόγος ψυχή ещё", "x² ½ ① № ™", "μm", "line\nbreak\ttab", "👩‍👧 ❤️", "с ним хорошо"]


def test_cases():
    for text, want in CASES.items():
        assert lookalikes.canonical(text) == want, text
    for text in ORDINARY:
        assert lookalikes.canonical(text) == unicodedata.normalize("NFC", text) == text


@settings(max_examples=400)
@given(st.text("ab é\u0301\u0308\u200b\u200d\u00a0　ａ１раохλ\u1161ﬁ⼯中，.\n👩", max_size=14))
def test_splicing_equals_whole_text_and_is_stable(text):
    once = lookalikes.canonical(text)
    assert once == lookalikes.canonical_whole(text)
    assert lookalikes.canonical(once) == once


def test_stable_class_holds_no_unstable_character():
    import re

    single, invisible, marks = lookalikes.properties()
    quick = re.compile("[^" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U" + m[1].rjust(8, "0"), lookalikes.stable_class()) + "]")
    assert all(quick.search(c) for c in {*single, *invisible, *marks, *lookalikes.LOOKALIKE})
    assert not quick.search("Plain text, 中文。 “é”\n")


def test_found_and_canonical(spark):
    rows = [(1, "ｘ", None), (2, "ok", "n\u00a0b"), (3, None, None), (4, "", " "), (5, "е" + "x" * 50_000, "хорошо")]
    df = spark.createDataFrame(rows, "row_id long, text string, gold_text string")
    assert sorted(map(tuple, lookalikes.found(df, "row_id", ["text", "gold_text"]).collect())) == [(1, "text"), (2, "gold_text"), (5, "text")]
    got = {r["row_id"]: r["form"] for r in lookalikes.with_canonical(df, {"text": "form"}).collect()}
    assert got[1] == "x" and got[2] == "ok" and got[3] is None and got[4] == "" and got[5] == "e" + "x" * 50_000
    assert lookalikes.found(df.limit(0), "row_id", ["text"]).count() == 0
