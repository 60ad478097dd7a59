"""Planning rules against worked values and invariants."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.functions.selectors import canonical_selector, manifest_name, parse_selector
from tapeloom.operators import batching, budget


def test_bin_edges():
    assert budget.bin_edges(30, 9) == [3, 7, 10, 13, 17, 20, 23, 27]
    assert budget.bin_edges(40, 9) == [4, 9, 13, 18, 22, 27, 31, 36]
    assert budget.bin_edges(5, 9) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert budget.bin_edges(float("nan"), 9) == budget.bin_edges(0, 9) == budget.bin_edges(30, 9)
    assert budget.bin_edges(30, 1) == []


def test_targets_and_budgets():
    targets = [budget.dataset_target(w, n) for w, n in ((1.0, 100), (0.5, 61), (2.5, 7), (0.001, 10))]
    assert targets == [100, 30, 18, 1]
    assert budget.mix_budget(targets, 4, 2, 2) == (9, [49, 14, 9, 0], 72)
    assert budget.mix_budget(targets, 4, 2, 2, most=100) == (6, [32, 10, 6, 0], 48)
    assert budget.worker_targets(72, 4, 4) == [20, 20, 16, 16]
    assert budget.worker_targets(72, 4, 5) == [16, 16, 16, 12, 12]
    with pytest.raises(ValueError):
        budget.step_budget(15, 4, 2, 2)
    assert budget.limited_total([3, 4], -1) == 0 and budget.limited_total([3, 4], None) == 7


def test_schedules():
    assert budget.lookahead(14, 5, "front") == [1] * 5 + [0] * 9
    assert [i for i, x in enumerate(budget.lookahead(14, 5, "even")) if x] == [0, 3, 6, 10, 13]
    assert budget.lookahead(14, 18, "even") == [2, 1, 1, 1, 2, 1, 1, 1, 1, 2, 1, 1, 1, 2]
    assert budget.total_steps(2.5, 1) == (3, 3) and budget.total_steps(0.1, 1) == (1, 1)
    assert round(budget.retry_seconds(8, 0.5, 8.0), 6) == 37.8
    assert budget.learning_rate_factor(0, 10, 100, 0.1) == 0.1 and budget.learning_rate_factor(100, 10, 100, 0.1) == pytest.approx(0.1)


def test_stable_seed():
    assert budget.stable_seed("dataset-mix", 42, 0, "acgn_zh") == 7354349873601578448
    assert budget.stable_seed("dataset-group", 42, 0, 0, 0, 0) == 2960891712615383789


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8), st.integers(0, 100))
def test_apportion_keeps_total(targets, percent):
    total = sum(targets) * percent // 100
    out = budget.apportion(targets, total)
    assert sum(out) == total and all(0 <= o <= t for o, t in zip(out, targets))


@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 4))
def test_workers_get_exactly_their_rows(targets, workers):
    capacities = [sum(targets) // workers + (w < sum(targets) % workers) for w in range(workers)]
    split = budget.datasets_to_workers(targets, capacities)
    assert [sum(r) for r in split] == targets and [sum(c) for c in zip(*split)] == capacities


def test_selectors():
    assert parse_selector("1_3") == parse_selector([1, "3"]) == parse_selector("1,3") == (1, 3)
    assert parse_selector("2-4") == (2, 3, 4) and parse_selector(None) == parse_selector(" ") == ()
    assert canonical_selector("4-5,1") == "1_4_5" and manifest_name("3,1") == "train_class_1_3.jsonl" and manifest_name(None) == "train_with_class.jsonl"
    for bad in (True, "4-2", [1, False], "x"):
        with pytest.raises(ValueError):
            parse_selector(bad)


def test_composer_worked_case():
    edges = budget.bin_edges(40, 9)
    rows = [("a", 3, 0), ("a", 4, 1), ("b", 4, 0), ("b", 5, 1), ("c", 20, 0), ("c", 21, 1), ("a", 22, 2), ("b", 38, 2)]
    samples = [batching.Sample(n, d, i, sum(e < n for e in edges)) for d, n, i in rows]
    steps = batching.balance(batching.compose(samples, 2, 9, budget.stable_seed("dataset-group", 42, 0, 0, 0, 0)), 2)
    assert [[[(s.dataset, s.length, s.bin) for s in b] for b in step] for step in steps] == [
        [[("a", 3, 0), ("b", 4, 0)], [("b", 38, 8), ("c", 21, 4)]],
        [[("b", 5, 1), ("a", 4, 0)], [("c", 20, 4), ("a", 22, 4)]],
    ]


@settings(max_examples=40)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from("abc")), min_size=1, max_size=40), st.integers(0, 2**40))
def test_composer_conserves_samples(rows, seed):
    edges = budget.bin_edges(40, 9)
    rows = rows[: len(rows) // 4 * 4]
    samples = [batching.Sample(n, d, i, sum(e < n for e in edges)) for i, (n, d) in enumerate(rows)]
    batches = batching.compose(samples, 4, 9, seed)
    assert all(len(b) == 4 for b in batches) and sorted(s for b in batches for s in b) == sorted(samples)
    steps = batching.balance(batches, 2)
    assert all(1 <= len(s) <= 2 for s in steps) and sum(map(len, steps)) == len(batches)


def test_composer_rejects_partial_batches():
    with pytest.raises(ValueError):
        batching.compose([batching.Sample(1, "a", 0, 0)], 2, 9, 1)


def test_cap_scales_the_targets_of_a_rank():
    steps, per_rank, total = budget.mix_budget([228, 47, 198, 163], 4, 2, 2, most=354)
    # 114, 23, 99, 81 scaled by 177 / 317 and cut to whole numbers are 63, 12, 55, 45: 175 rows, 21 steps of 8
    assert (steps, total) == (21, 168) and sum(per_rank) == 168
    assert budget.mix_budget([40, 41], 4, 2, 1, most=10_000) == budget.mix_budget([40, 41], 4, 2, 1)
