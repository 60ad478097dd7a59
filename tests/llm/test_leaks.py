from __future__ import annotations

import random

import numpy as np
import pytest

from tapeloom.llm import leaks

WORDS = [f"w{i}" for i in range(400)]


def slow_align(a, b, penalty):
    best = (0, 0, 0)
    row = [(0, 0, 0)] * (len(b) + 1)
    for x in a:
        new = [(0, 0, 0)]
        for j, y in enumerate(b, 1):
            s, m, e = row[j - 1]
            options = [(s + 1, m + 1, e)] if x == y else [(s - penalty, m, e + 1)]
            options += [(p[0] - penalty, p[1], p[2] + 1) for p in (row[j], new[j - 1])]
            new.append(max([(0, 0, 0), *options], key=lambda t: (t[0], t[1])))
        row = new
        best = max(best, *row, key=lambda t: (t[0], t[1]))
    return best[1], best[2]


def test_alignment_matches_plain_one():
    rng = random.Random(3)
    for _ in range(60):
        a, b = [rng.randint(1, 4) for _ in range(rng.randint(1, 9))], [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        for penalty in (2, 4):
            assert leaks.align(np.array(a), np.array(b), penalty) == slow_align(a, b, penalty)


def edited(words, rng, every):
    out = []
    for i, w in enumerate(words):
        kind = rng.choice(["swap", "drop", "add"]) if i % every == every - 1 else "keep"
        out += {"keep": [w], "swap": ["other"], "drop": [], "add": [w, "other"]}[kind]
    return out


def found(items, texts):
    return {(d, i) for d, i, *_ in leaks.Index(list(enumerate(items))).overlaps(texts)}


def test_recall_of_edited_halves_and_no_false_hits():
    rng = random.Random(5)
    items = [[rng.choice(WORDS) for _ in range(rng.randint(24, 60))] for _ in range(60)]
    texts, want = [], set()
    for k, words in enumerate(items):
        noise = lambda n: [rng.choice(WORDS) for _ in range(n)]
        at = rng.randint(0, len(words) // 3)
        part = edited(words[at : at + len(words) * 5 // 8], rng, 9)
        want.add((len(texts), k))
        texts.append(" ".join(noise(40) + part + noise(30)).upper())
        texts.append(" ".join(noise(20) + words[: len(words) * 2 // 5] + noise(20)))  # too small a part
        texts.append(" ".join(edited(words, rng, 3)))  # too many edits
    assert found([" ".join(w) for w in items], texts) == want


def test_chinese_case_and_accents():
    item = "昨天下午老师在图书馆门口修好了那台旧钟，然后和学生一起去河边散步"
    texts = [item.replace("，", " \n").replace("旧", "新"), item[: len(item) // 3], "Élève " * 3, None, ""]
    assert found([item, "eleve ELEVE élève", "", None], texts) == {(0, 0), (2, 1)}


@pytest.mark.parametrize("block", [10, 500_000])
def test_blocks_give_the_same(spark, block):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(20)), "x") for i in range(6)]
    docs = [(10 + i, t + " tail" * (20_000 if i == 2 else 1), "y") for i, t, _ in items] + [(99, None, "y"), (98, "", "y"), (97, items[0][1], "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, suite string")
    e = spark.createDataFrame([*items, (7, None, "x"), (8, items[0][1], "x")], "item_id long, text string, suite string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.overlaps(d, "doc_id", "text", e, "item_id", "text", block).collect()}
    assert got == {(10 + i, i) for i in range(6)} | {(10, 8), (97, 0), (97, 8)}
    assert leaks.overlaps(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0
    assert leaks.overlaps(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("kind", ["add", "drop", "swap"])
def test_recall_at_the_limit(kind):
    """Half an item with one edit anywhere, for items whose half has the eight tokens that an edit takes."""
    rng = random.Random(kind)
    words = [f"x{i}" for i in range(3000)]
    for n in (16, 18, 20, 24, 32, 40, 60):
        items, texts = [], []
        for _ in range(60):
            item = [rng.choice(words) for _ in range(n)]
            size = -(-n // 2)
            at, e = rng.randint(0, n - size), rng.randrange(size)
            part = item[at : at + size]
            part[e : e + 1] = {"add": [part[e], "new"], "drop": [], "swap": ["new"]}[kind]
            items.append(" ".join(item))
            texts.append(" ".join([rng.choice(words) for _ in range(30)] + part + [rng.choice(words) for _ in range(30)]))
        hits = found(items, texts)
        assert len({(k, k) for k in range(60)} & hits) >= 57 and len(hits) <= 60
