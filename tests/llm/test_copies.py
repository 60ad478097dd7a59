from __future__ import annotations

import json
import unicodedata
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import copies
from tapeloom.operators import skew

SCHEMA = "table_name string, id long, text string, audio_ref string, extra string"


def fold(s):
    return "".join(c for c in s if not c.isspace() and unicodedata.category(c)[0] != "P").casefold()


def brute(rows):
    groups = defaultdict(list)
    for table, i, text, ref, *_ in rows:
        if text is not None and ref is not None and fold(text) and fold(ref):
            groups[table, fold(text), fold(ref)].append(i)
    return sorted((t, min(v), i) for (t, _, _), v in groups.items() for i in v if i != min(v))


ROWS = [
    ("manifest", 1, "Hello, World!", "oss://a/b.wav", "x"),
    ("manifest", 2, "hello world", "OSS a b WAV", None),
    ("manifest", 3, "dlrow olleh", "oss://a/b.wav", "x"),
    ("manifest", 4, None, "oss://a/b.wav", "x"),
    ("manifest", 5, None, "oss://a/b.wav", "x"),
    ("manifest", 6, " ,. ", "oss://a/b.wav", "x"),
    ("manifest", 7, "", "oss://a/b.wav", "x"),
    ("manifest", 8, "STRASSE", "r", "x"),
    ("manifest", 9, "straße", "R.", "x"),
    ("manifest", 10, "a" * 60_000, "r", "x"),
    ("manifest", 11, "A " * 60_000, "r", "x"),
    ("shard_lines", 1, "hello　world", "oss://a/b.wav", "x"),
    ("shard_lines", 12, "HELLO\tworld…", "oss a/b_wav", "x"),
]


def test_groups_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, copies.found(df).collect())) == brute(ROWS)
    assert copies.found(df.limit(0)).count() == 0


def test_collapsed_counts(spark):
    got = {(r["table_name"], r["id"]): r["n_copies"] for r in copies.collapsed(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got["manifest", 1] == 2 and got["manifest", 4] == got["manifest", 5] == got["manifest", 3] == 1 and ("manifest", 2) not in got
    assert sum(got.values()) == len(ROWS)


def test_hot_group_is_spread(spark, monkeypatch):
    monkeypatch.setattr(copies, "attach_group_values", lambda *a: skew.attach_group_values(*a, hot_rows=10))
    rows = [("manifest", i, "Same text." if i % 3 else f"other {i}", "ref", None) for i in range(120)]
    assert sorted(map(tuple, copies.found(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("aAßs ,é́", max_size=4), st.text("aA-", max_size=3)), min_size=1, max_size=25))
def test_random_rows(spark, pairs):
    rows = [("manifest", i, t, r, None) for i, (t, r) in enumerate(pairs)]
    assert sorted(map(tuple, copies.found(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_only_whole_objects_count(spark):
    raws = [json.dumps({"audio_ref": "r", "text": "é"}), '{"text":"\\u00e9","audio_ref":"r"}', '[{"text":"é","audio_ref":"r"}]', '{"text":"é","audio_ref":"r"', "{'text':'é','audio_ref':'r'}", "", None, '{"text":null,"audio_ref":"r"}']
    lines = spark.createDataFrame(list(enumerate(raws)), "line_id long, raw string")
    got = {r["line_id"]: (r["text"], r["audio_ref"]) for r in copies.json_records(lines, "line_id", "raw").collect()}
    assert got == {0: ("é", "r"), 1: ("é", "r"), **{i: (None, None) for i in (2, 3, 4, 5, 6)}, 7: (None, "r")}
