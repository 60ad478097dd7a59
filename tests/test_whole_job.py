"""Queries that must do the whole job: nothing that was planned or given may be lost."""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import functions as F

from tapeloom.functions import text
from tapeloom.functions.selectors import parse_selector
from tapeloom.operators import budget
from tapeloom.plans import batches, catalog, mixing, texts


def test_composer_keeps_every_planned_row(spark, data):
    local = sorted(mixing._targets(spark, data, mixing.keyed_rows(spark, data)))
    _, per_rank, total = budget.mix_budget([t for _, _, t in local], mixing.BATCH, mixing.WORLD, mixing.ACCUMULATION)
    rows = mixing.composed_batches(spark, data).select("rank", "dataset_key", "group_no", "step_no", "micro_batch").collect()
    planned = {(r, k): n for (k, _, _), n in zip(local, per_rank) if n for r in range(mixing.WORLD)}
    assert Counter((r["rank"], r["dataset_key"]) for r in rows) == planned
    assert len(rows) == total * mixing.WORLD and 0 <= sum(t // mixing.WORLD for _, _, t in local) - total < mixing.BATCH * mixing.ACCUMULATION
    assert set(Counter((r["rank"], r["group_no"], r["step_no"], r["micro_batch"]) for r in rows).values()) == {mixing.BATCH}


def test_class_filter_uses_every_files_own_selector(spark, tmp_path):
    files = {"a": "1_3", "b": "1,3", "c": "2-4", "d": " ", "e": None, "f": "5, 7-8_1"}
    spark.createDataFrame(list(files.items()), "train_path string, class_selector string").write.parquet(str(tmp_path / "dataset_specs.parquet"))
    rows = [(i, "abcdefg"[i // 9]) for i in range(63)]
    spark.createDataFrame(rows, "row_id long, source_path string").write.parquet(str(tmp_path / "manifest.parquet"))
    expected = {(i, i % 9 + 1) for i, f in rows if f in files and (not parse_selector(files[f]) or i % 9 + 1 in parse_selector(files[f]))}
    got = [tuple(r) for r in catalog.queries()["class_filter_by_file"](spark, str(tmp_path)).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_result_json_keeps_every_row(spark, tmp_path):
    paths = ["a/b.wav", None, 'quo"te.wav', "back\\slash", "tab\tline\n\x01\x1f", "目录/é.wav", "\u2028\x7f😀", "", "</a>&'"]
    langs = ["zh", " zh", None, "EN ", "d\"e", "中", "", "fr", "x_y"]
    rows = [(i, p, l, "2.5") for i, (p, l) in enumerate((p, l) for p in paths for l in langs)]
    df = spark.createDataFrame(rows, "row_id long, audio_path string, lang string, duration_sec string").withColumn("duration", F.lit(None).cast("string"))
    df.write.parquet(str(tmp_path / "manifest.parquet"))
    got = {r["row_id"]: r for r in catalog.queries()["result_json_all"](spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, *_ in rows}
    for i, path, lang, _ in rows:
        assert json.loads(got[i]["line"]) == {"audio": path, "lang_code": None if lang is None else lang.strip().lower(), "pred_text": "x"} and "\n" not in got[i]["line"]
    assert '"目录/é.wav"' in got[5 * len(langs)]["line"]


def stripped(said):
    """The rule step by step: white space, marker, a known language name, a tag, until nothing changes."""
    while True:
        before, said = said, said.lstrip()
        if said.startswith("<asr_text>"):
            said = said[len("<asr_text>") :]
        elif (m := re.match(r"language\s+([A-Za-z_]+)", said, re.I)) and any(m[1].lower() == n or m[1].lower().startswith(n + "_") for n in ("chinese", "english", "german", "french")):
            said = said[m.end() :]
        elif m := re.match(r"<\|[^>]+\|>", said):
            said = said[m.end() :]
        elif said == before:
            return said


def test_control_prefix_strip_keeps_every_row(spark, tmp_path):
    texts = [None, "", "plain", "language English<asr_text>x", "language lessons", "LANGUAGE German_ x", "<b> y", "<|a|>z", "<||>z", "<|a>|>", "\x1c<asr_text>\x1dq", "language\x1fFrench r", "　<|x|>　language chinese_zh 语", "<asr_text> language Spanish", "language English1", "language Englishé"]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    spark.createDataFrame(rows, "row_id long, text string").write.parquet(str(tmp_path / "manifest.parquet"))
    prefix = (" language English_US<asr_text>", "<|x|> language ChinEse <asr_text> ", "language Englishx", "")
    got = dict(tuple(r) for r in catalog.queries()["control_prefix_strip_all"](spark, str(tmp_path)).collect())
    assert got == {i: None if t is None else stripped(prefix[i % 4] + t) for i, t in rows}


def test_paths_are_looked_up_by_filename_last(spark, tmp_path):
    # rows whose number divides by three aren't listed; the others' audio_path is
    rows = [
        (1, "audio/a.wav", None, None), (2, "audio/sub/b.mp3", None, None), (4, "audio/sub/b.flac", None, None), (5, "audio/x/c.txt", None, None), (7, "other/d.wav", None, None), (8, "audio/deep/in/e.WAV", None, None),
        (9, None, None, " a.wav "), (12, "audio/gone.wav", None, "b.ogg"), (15, None, None, "c.txt"), (18, None, None, "d.wav"), (21, None, "/mnt/r.wav", "a.wav"), (24, None, "oss://b/" + "k" * 12_000, "a.wav"),
        (27, None, None, "in/e.WAV"), (30, None, None, "n/e.WAV"), (33, None, None, ""), (36, None, " ", "a.ogg"), (39, None, None, "sub/a.wav"),
    ]
    spark.createDataFrame(rows, "row_id long, audio_path string, audio_ref string, filename string").write.parquet(str(tmp_path / "manifest.parquet"))
    got = {r["row_id"]: (r["resolved"], r["priority"]) for r in catalog.queries()["path_priority_by_name"](spark, str(tmp_path)).collect()}
    expected = {i: (p, 1) for i, p, *_ in rows if i < 9} | {
        9: ("audio/a.wav", 8), 12: ("audio/sub/b.mp3", 9), 15: ("audio/x/c.txt", 10), 18: (None, None), 21: ("/mnt/r.wav", 7), 24: ("/cache/b/" + "k" * 12_000, 6),
        27: ("audio/deep/in/e.WAV", 10), 30: (None, None), 33: (None, None), 36: ("audio/a.wav", 9), 39: ("audio/a.wav", 9),
    }
    assert got == expected
    assert max(len(r["resolved"] or "") for r in catalog.queries()["path_priority"](spark, str(tmp_path)).collect()) == 12_009


def test_packs_hold_every_rows_own_length(spark, tmp_path):
    rows = [(i, list(range(100 * i, 100 * i + n))) for i, n in enumerate((3, 12, 0, 7, 1, 5))] + [(6, None), (70, [0, 0, 9, 0, 0, 0, 0])]
    spark.createDataFrame(rows, "row_id long, token_ids array<long>").write.parquet(str(tmp_path / "manifest.parquet"))
    got = {r["batch"]: r["packed"] for r in catalog.queries()["ragged_pack_whole"](spark, str(tmp_path)).collect()}
    assert got == {0: [x for i, ids in rows[:6] for x in ids], 1: [0, 0, 9, 0, 0, 0, 0]}
    some = spark.createDataFrame([(0, 2, [5, 6, 7], 2), (0, 1, [1, 2, 3], 0), (0, 3, [8, 9], None), (0, 4, None, 2), (0, 0, [4], 3)], "batch int, i int, x array<int>, n int")
    assert [r["packed"] for r in batches.packed(some, "batch", "i", "x", "n").collect()] == [[4, 5, 6, 8, 9]]


def test_retry_knows_every_part_type_and_code(spark):
    again = [
        (None, None, "x PartitionQpsLimitted", None), (None, None, "partition qps limitted", None), (None, None, "Please retry later.", None), (None, None, "Too many requests", None), (None, None, "temporarily UNAVAILABLE", None), (None, None, "Read timeout", None),
        (None, None, "connection aborted", None), (None, None, "stream was reset", None), (None, None, "Refused", None), (None, None, "Broken pipe", None), (None, None, "network unreachable", None), (None, None, "[Errno 104]", None),
        (None, None, None, "PartitionQpsLimitted"), (None, None, "no", "ConnectionTimeout"), (503, None, None, None), *((None, t, "no", None) for t in ("ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "BrokenPipeError", "TimeoutError")),
    ]
    never = [(404, "KeyError", "no such key", "NoSuchKey"), (None, None, None, None), (403, "OssError", "AccessDenied", None)]
    df = spark.createDataFrame(again + never, "status int, kind string, message string, code string")
    got = [r[0] for r in df.select(text.retryable(F.col("status"), F.col("kind"), F.col("message"), F.col("code"))).collect()]
    assert got == [True] * len(again) + [False] * len(never)


def test_references_are_tried_in_order(spark):
    listing = spark.createDataFrame([(x,) for x in ("a", "b", "w", "p", "/local")], "path string")
    rows = [
        (1, " a ", "w", None, None, "p", "oss://b/k"), (2, "gone", "w", None, None, "p", "oss://b/k"), (3, None, " ", "gone", None, "p", "/local"), (4, None, None, None, "b", None, None), (5, "gone", None, None, None, None, "oss://b/k"),
        (6, None, None, None, None, None, " /local "), (7, None, None, None, None, None, "/missing"), (8, None, None, None, None, None, ""), (9, None, None, None, None, None, None), (10, "", "gone", "", "", "", "oss://"),
    ]
    df = spark.createDataFrame(rows, "row_id long, audio_path string, wav_path string, audio_local_path string, local_audio_path string, path string, audio_ref string")
    got = {r["row_id"]: (r["resolved"], r["priority"]) for r in texts.resolved_references(df, listing).collect()}
    assert got == {1: ("a", 1), 2: ("w", 2), 3: ("p", 5), 4: ("b", 4), 5: ("/cache/b/k", 6), 6: ("/local", 7), 7: (None, None), 8: (None, None), 9: (None, None), 10: ("/cache/", 6)}
    assert texts.resolved_references(df.limit(0), listing).count() == 0
