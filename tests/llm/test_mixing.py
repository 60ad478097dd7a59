from __future__ import annotations

from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from tapeloom.llm import mixing


@given(st.lists(st.tuples(st.floats(0, 10), st.integers(0, 50)), min_size=1, max_size=7), st.integers(0, 150))
def test_proportional_keeps_rooms_and_total(parts, total):
    weights, rooms = [w for w, _ in parts], [r for _, r in parts]
    out = mixing.proportional(total, weights, rooms)
    assert all(0 <= x <= r for x, r in zip(out, rooms)) and sum(out) == min(total, sum(r for w, r in parts if w > 0))


def test_shortage_goes_to_siblings_first():
    leaves = [(("d", "en", "a"), 1.0, 10), (("d", "en", "b"), 1.0, 100), (("d", "zh", "c"), 2.0, 100)]
    assert mixing.allocate(mixing.tree(leaves), 80) == {("d", "en", "a"): 10, ("d", "en", "b"): 30, ("d", "zh", "c"): 40}
    leaves[1] = (("d", "en", "b"), 1.0, 15)
    assert mixing.allocate(mixing.tree(leaves), 80) == {("d", "en", "a"): 10, ("d", "en", "b"): 15, ("d", "zh", "c"): 55}


def tables(spark):
    specs = [("f1", "A_en", 1.0, 60, "r"), ("f2", "a_en ", 1.0, 40, "r"), ("f3", "b_en", 3.0, 10, "r"), ("f4", "c", 0.0, 5, "r"), ("f5", "d_zh", None, 5, "r"), ("f6", "gone_zh", 2.0, 10, None), ("f7", "e_zh", 1.0, 40, "r"), (None, None, 1.0, 4, "r")]
    rows = [(i, "f1" if i < 60 else "f2", None if i % 2 else " a_EN") for i in range(100)] + [(200 + i, "f3", "b_en") for i in range(10)] + [(300 + i, "f7", "") for i in range(40)] + [(400, "f4", "c"), (401, "nowhere", None), (402, "f3", "unknown")]
    plans = [("small", 0.5, 4), ("big", 2.0, 8), ("once", 1.0, 1), ("none", 0.0, 3), ("null", None, None)]
    return (
        spark.createDataFrame(rows, "row_id long, source_path string, dataset_key string"),
        spark.createDataFrame(specs, "train_path string, dataset_key string, weight double, count long, data_root string"),
        spark.createDataFrame(plans, "plan_name string, size_factor double, max_repeats int"),
    )


def test_selection_follows_the_report(spark):
    inputs = tables(spark)
    report = {(r["plan_name"], r["source"]): r for r in mixing.budgets(*inputs).collect()}
    assert {s for _, s in report} == {"a_en", "b_en", "gone_zh", "e_zh"}
    taken = mixing.selection(*inputs).collect()
    assert len({(r["plan_name"], r["row_id"]) for r in taken}) == len(taken)
    sizes, repeats = Counter(), {}
    for r in taken:
        sizes[r["plan_name"], r["source"]] += r["times"]
        repeats.setdefault((r["plan_name"], r["source"]), set()).add(r["times"])
    for key, r in report.items():
        assert sizes[key] == r["size"] and max(repeats.get(key, {0})) == r["repeats"]
        assert max(repeats.get(key, {0})) - min(repeats.get(key, {0})) <= 1
    limits = {"small": 4, "big": 8, "once": 1}
    assert all(r["times"] <= limits[r["plan_name"]] for r in taken)
    assert sum(r["size"] for (p, _), r in report.items() if p == "big") == 320 and report["big", "gone_zh"]["size"] == 0
    assert report["once", "b_en"]["size"] == 10  # capped at its records
    assert abs(sum(r["actual_share"] for (p, _), r in report.items() if p == "small") - 1) < 1e-9


def test_repeatable_and_empty(spark):
    records, specs, plans = tables(spark)
    first = sorted(map(tuple, mixing.selection(records, specs, plans).collect()))
    assert first == sorted(map(tuple, mixing.selection(records.repartition(7), specs, plans).collect()))
    assert mixing.selection(records.limit(0), specs, plans).count() == 0
    assert mixing.budgets(records, specs.limit(0), plans).count() == 0
    assert mixing.budgets(records, specs, plans.limit(0)).count() == 0


def test_prefix_by_size(spark):
    records, specs, plans = tables(spark)
    sized = records.selectExpr("*", "case when row_id % 11 = 0 then null when row_id % 13 = 0 then -5 else row_id % 7 end as n_tokens")
    real = {r["row_id"]: max(0, r["n_tokens"] or 0) for r in sized.collect()}
    report = {(r["plan_name"], r["source"]): r for r in mixing.budgets(sized, specs, plans, "n_tokens").collect()}
    sizes, times = Counter(), {}
    for r in mixing.selection(sized, specs, plans, size="n_tokens").collect():
        sizes[r["plan_name"], r["source"]] += r["times"] * real[r["row_id"]]
        times.setdefault((r["plan_name"], r["source"]), []).append(r["times"])
    for key, r in report.items():
        assert r["size"] - 6 < sizes[key] + (not r["size"]) and sizes[key] <= r["size"]  # less than one record below
        assert max(times.get(key, [0])) <= max(1, r["repeats"]) and r["size"] <= 8 * r["available"]
    assert sum(r["size"] for (p, _), r in report.items() if p == "small") == round(0.5 * sum(round(r["declared"] * r["available"] / r["records"]) if r["records"] else round(r["declared"] * mean(report)) for (p, _), r in report.items() if p == "small"))


def mean(report):
    rows = [r for (p, _), r in report.items() if p == "small"]
    return sum(r["available"] for r in rows) / sum(r["records"] for r in rows)
