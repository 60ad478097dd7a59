from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(0, 40), max_size=25))
def test_plan_places_everything_once(histogram):
    runs = packing.plan(dict(histogram), 100)
    placed = Counter()
    for contents, number in runs:
        assert sum(k * v for k, v in contents) <= 100 and number > 0
        for length, each in contents:
            placed[length] += each * number
    assert placed == Counter({k: v for k, v in histogram.items() if v})
    total = sum(k * v for k, v in histogram.items())
    assert sum(n for _, n in runs) <= 2 * total / 100 + 1


def test_fill_is_close_to_full():
    rng = np.random.default_rng(2)
    histogram = Counter(np.minimum(1 + rng.lognormal(5, 1, 20_000).astype(int), 1024).tolist())
    containers = sum(n for _, n in packing.plan(dict(histogram), 1024))
    assert sum(k * v for k, v in histogram.items()) / 1024 / containers > 0.99


def test_nnls_finds_exact_and_boundary_solutions():
    rng = np.random.default_rng(0)
    a = rng.random((12, 6))
    x = np.array([0, 2.0, 0, 1.0, 0, 3.0])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    assert (packing.nnls(a, -np.ones(12)) == 0).all()


def test_packed(spark):
    texts = ["one two three", "", None, "   ", "word " * 700, "一二三四五六", "one two three", "x" * 30] + [f"number {i} is here" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, capacity string")
    packs = spark.createDataFrame([("a", 64), ("b", 16), ("none", 0), ("null", None)], "pack_name string, capacity long")
    pieces = packing.packed(docs, "doc_id", "text", packs).collect()
    lengths = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs, "doc_id", "text").collect()}
    assert {r["pack_name"] for r in pieces} == {"a", "b"} and 1 not in lengths and 2 not in lengths and 3 not in lengths
    for name, capacity in (("a", 64), ("b", 16)):
        by_doc, by_container = defaultdict(list), Counter()
        for r in pieces:
            if r["pack_name"] == name:
                by_doc[r["doc_id"]].append((r["piece_no"], r["first_token"], r["n_tokens"]))
                by_container[r["container_id"]] += r["n_tokens"]
        assert set(by_doc) == set(lengths) and max(by_container.values()) <= capacity
        for doc, own in by_doc.items():
            assert sum(n for *_, n in own) == lengths[doc] and len(own) == -(-lengths[doc] // capacity)
            at = 0
            for _, first, n in sorted(own):
                assert first == at
                at += n
    fills = packing.fills(packing.packed(docs, "doc_id", "text", packs), packs).collect()
    assert all(r["fill"] <= r["capacity"] for r in fills) and sum(r["n_pieces"] for r in fills) == len(pieces)
    assert packing.packed(docs.limit(0), "doc_id", "text", packs).count() == 0 and packing.packed(docs, "doc_id", "text", packs.limit(0)).count() == 0


def test_patterns_begin_most_containers():
    rng = np.random.default_rng(5)
    for capacity, texts in ((256, 20_000), (2048, 20_000), (8192, 200_000)):
        histogram = Counter((1 + rng.lognormal(5, 1, texts).astype(int) % (capacity - 1)).tolist())
        parts = packing.plan_parts(dict(histogram), capacity)
        number = sum(n for *_, n in parts)
        assert sum(n for origin, _, n in parts if origin == "pattern") > 0.9 * number
        assert sum(k * v for k, v in histogram.items()) / capacity / number > 0.995
