"""Operators on small literal tables: nulls, ties, repeats, empty input, clashing columns, hot keys."""

from __future__ import annotations

import json
import math
import random
import struct
import wave

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import fields, text, tokens
from tapeloom.operators import collate, masks, metrics, sampling, skew
from tapeloom.plans import parameters
from tapeloom.sources import config, files, jsonl


def column(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_durations(spark):
    values = ["", "abc", "NaN", "Infinity", "0", "-1", None, " 2.5 ", "1e1", "5d", ".5"]
    assert column(spark, fields.positive_number, values) == [None] * 7 + [2.5, 10.0, None, 0.5]


def test_guard_keeps_unknown_and_equal(spark):
    assert column(spark, lambda v: fields.over_cap(v, 15.0), [15.0, 15.01, None, 0.0], "double") == [False, True, False, False]
    assert column(spark, lambda v: fields.over_cap(v, 0), [99.0], "double") == [False]


def test_bins_are_right_closed(spark):
    assert column(spark, lambda v: fields.length_bin(v, [3, 7]), [3.9, 4.0, 7.5, 8.0, -1.0, None], "double") == [0, 1, 1, 2, 0, 0]


def test_targets(spark):
    rows = [(None, None, "t", "g", "EN "), (" x ", None, "t", None, "en"), (None, "  ", "t", None, "zh"), (None, None, None, "g", "es"), (None, None, None, None, "fr")]
    df = spark.createDataFrame(rows, "target string, norm string, txt string, gold string, lang string")
    got = [r[0] for r in df.select(fields.target_text(F.col("target"), [F.col("norm"), F.col("txt"), F.col("gold")], F.col("lang"))).collect()]
    assert got == ["language English<asr_text>t", "x", "language Chinese<asr_text>", None, "language French<asr_text>"]
    with pytest.raises(ValueError):
        fields.target_text(F.col("a"), [F.col("b")], F.col("c"), "other")


def test_normalisation(spark):
    values = ["你 好 ， 世界 ab", "你 好 。 世界", "　ａ b  c ", "", None]
    assert column(spark, lambda v: text.normalized(v, F.lit("zh")), values) == ["你好 , 世界 ab", "你好。世界", "a b c", None, None]
    assert column(spark, lambda v: text.normalized(v, F.lit("es")), ["x"]) == [None]


def test_control_prefix(spark):
    values = ["language English_US<asr_text>x", "language Englishx", " <|a|> <asr_text>y", "plain", ""]
    assert column(spark, text.without_control_prefix, values) == ["x", "language Englishx", "y", "plain", ""]


def test_uri(spark):
    assert column(spark, lambda v: text.cache_path(v, "/c"), ["oss://b/k/x", "oss://b", "/local", None]) == ["/c/b/k/x", None, None, None]
    assert column(spark, text.parameter_count, [0, 999, 1000, 186376000, 2025000000], "long") == ["0", "999", "1.00K", "186.38M", "2.02B"]


def test_metrics_of_empty_lengths(spark):
    rows = spark.createDataFrame([(0, "a", 0, None, False), (0, "b", -3, -1.0, True), (1, "a", 4, 2.0, None), (1, "a", 2, float("1"), False)], "b int, dataset_key string, length long, seconds double, is_replacement boolean")
    got = {r["b"]: r for r in metrics.micro_batch_metrics(rows, ["b"]).collect()}
    assert (got[0]["padding_ratio"], got[0]["cost"], got[0]["replacements"], got[0]["datasets"]) == (0.0, 0, 1, 2)
    assert (got[1]["padding_ratio"], got[1]["cost"], got[1]["dominant_ratio"], got[1]["max_seconds"]) == (0.25, 8, 1.0, 2.0)
    assert metrics.micro_batch_metrics(rows.limit(0), ["b"]).count() == 0


def test_collate(spark):
    rows = spark.createDataFrame([(1, [5, 6], [5, 6, 2], "x"), (1, None, None, "y"), (1, [9], [9], "z")], "batch int, ids array<bigint>, labels array<bigint>, width string")
    got = sorted(tuple(map(tuple, r)) for r in collate.collated(rows.drop("width"), "batch", "ids", "labels", 0).select("input_ids", "attention_mask", "label_ids").collect())
    assert got == [((0, 0, 0), (0, 0, 0), (-100, -100, -100)), ((5, 6, 0), (1, 1, 0), (5, 6, 2)), ((9, 0, 0), (1, 0, 0), (9, -100, -100))]


def test_unique_ids(spark):
    assert column(spark, collate.unique_ids, [[3, -1, 3, None, 1], [], None], "array<bigint>") == [[3, 1], [], None]


def test_block_interval_matches_predicate(spark):
    n = 11
    pairs = spark.range(n).withColumnRenamed("id", "i").join(spark.range(n).withColumnRenamed("id", "j"), F.lit(True))
    for left in (None, 3):
        low, high = masks.block_interval(F.col("i"), F.lit(n), 4, left)
        both = pairs.select(masks.block_visible(F.col("i"), F.col("j"), 4, left).alias("a"), ((F.col("j") >= low) & (F.col("j") <= high)).alias("b"))
        assert both.filter("a != b").count() == 0


def test_oversampling_counts(spark):
    rows = spark.createDataFrame([("k", i) for i in range(7)] + [("other", 1)], "key string, id long")
    targets = spark.createDataFrame([("k", 7, 17), ("none", 0, 3)], "key string, n long, target long")
    got = sampling.oversampled(rows, "key", "id", targets, 1).collect()
    counts = {}
    for r in got:
        counts[r["id"]] = counts.get(r["id"], 0) + 1
    assert sorted(r["position"] for r in got) == list(range(17)) and set(counts.values()) == {2, 3} and len(counts) == 7


def test_ranks_are_whole_when_sliced(spark):
    rows = spark.range(500).select(F.lit("hot").alias("k"), F.col("id"), F.lit("x").alias("rank_")).unionByName(spark.createDataFrame([("cold", 1, "y")], "k string, id long, rank_ string"))
    whole = {(r["k"], r["id"]): r["rank"] for r in skew.ranked_within(rows, ["k"], F.xxhash64("id"), "id").collect()}
    sliced = {(r["k"], r["id"]): r["rank"] for r in skew.ranked_within(rows, ["k"], F.xxhash64("id"), "id", group_rows=10).collect()}
    assert whole == sliced and sorted(v for (k, _), v in sliced.items() if k == "hot") == list(range(500))
    assert skew.ranked_within(rows.limit(0), ["k"], F.xxhash64("id"), "id").count() == 0


def test_attach_hot_groups(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 200, 1).when(F.col("id") < 290, F.col("id") % 7 + 2).cast("long").alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    expected = sorted(tuple(r) for r in rows.join(groups, "k").select("id", "first").collect())
    for hot in (50, 10_000):
        assert sorted(tuple(r) for r in skew.attach_group_values(rows, groups, "k", "n", hot).select("id", "first").collect()) == expected
    assert skew.attach_group_values(rows, groups.limit(0), "k", "n").count() == 0


def test_last_good(spark):
    rows = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(10)] + [("b", 1, False)], "g string, o int, ok boolean")
    assert [(r["o"], r["pool_no"]) for r in sampling.last_good(rows, "g", "o", F.col("ok"), 3).orderBy("o").collect()] == [(4, 0), (6, 1), (8, 2)]


def test_jsonl_source(spark, tmp_path):
    lines = ['{"utt_id": "a", "text": "é"}', "", "  ", "[1]", '{"cut', '{"utt_id": null}']
    (tmp_path / "x.jsonl").write_bytes("\n".join(lines).encode())
    rows = jsonl.read_offsets(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["byte_offset"]) for r in rows] == [(1, 0), (4, 34), (5, 38), (6, 44)]
    for r in rows:
        data = (tmp_path / "x.jsonl").read_bytes()[r["byte_offset"] :]
        assert data.split(b"\n")[0].decode().strip() == r["raw"]
    reasons = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in [*lines, None]], "raw string").select("raw", jsonl.reject_reason(F.col("raw"))).collect()}
    assert reasons == {lines[0]: None, "": "blank", "  ": "blank", "[1]": "not_an_object", '{"cut': "malformed_json", lines[5]: None, None: "blank"}
    (tmp_path / "none").mkdir()
    assert jsonl.read_offsets(spark, str(tmp_path / "none")).count() == 0


def test_append_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([("é",)], "text string").coalesce(1)
    jsonl.append_jsonl(rows, str(tmp_path / "out"))
    jsonl.append_jsonl(rows, str(tmp_path / "out"))
    found = [json.loads(line) for p in (tmp_path / "out").glob("*.json") for line in p.read_text().splitlines()]
    assert found == [{"text": "é"}] * 2


def test_wav_files(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(b"".join(struct.pack("<hh", 1000, 3000) for _ in range(8000)))
    (tmp_path / "b.wav").write_bytes(b"no audio")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.WAV").write_bytes(b"x")
    (tmp_path / "c.txt").write_text("")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.decoded(spark, str(tmp_path)).collect()}
    assert got["a.wav"]["seconds"] == 1.0 and math.isclose(got["a.wav"]["samples"][5], 2000 / 32768, rel_tol=1e-4) and got["b.wav"]["samples"] is None
    names = files.listing(spark, str(tmp_path))
    assert sorted(r["name"] for r in names.collect()) == ["a.WAV", "a.wav", "b.wav"]
    assert {r["stem"] for r in files.first_by(names, "stem").collect()} == {"a", "b"}


def test_config(tmp_path):
    settings = {"a": {"b": None, "c": 0}}
    assert config.deep_get(settings, "a.b", 5) is None and config.deep_get(settings, "a.x", 5) == 5 and config.deep_get(settings, "a.c.d", 7) == 7
    path = str(tmp_path / "new" / "x.json")
    config.save_json(path, {"k": "é"})
    assert config.load_index(path) == {"k": "é"} and "é" in (tmp_path / "new" / "x.json").read_text()
    config.save_json(path, [1])
    with pytest.raises(ValueError):
        config.load_index(path)


def test_projection(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "k int, x array<float>")
    got = {r["k"]: r["projected"] for r in collate.low_rank_projection(rows, "k", "x", [[1, 0]], [[1], [1]], [[2]], 0.5).collect()}
    assert got == {1: [1.0 + 0.5 * 3 * 2], 2: None, 3: None}


def test_interval_metrics_by_hand(spark):
    # (rank, step, micro-batch, dataset, length, seconds, replacement)
    rows = [
        (0, 0, 0, "a", 4, 1.0, False), (0, 0, 0, "b", 2, 2.0, True), (0, 0, 1, "a", 3, 3.0, False), (0, 1, 0, "a", 10, 1.0, False),
        (1, 0, 0, "c", 6, 5.0, False), (1, 0, 0, "c", 0, 0.0, False), (1, 2, 0, "a", 1, 1.0, False),
    ]
    df = spark.createDataFrame(rows, "rank int, step long, mb int, dataset_key string, length long, seconds double, is_replacement boolean")
    got = metrics.interval_metrics(metrics.step_metrics(df, ["rank", "step", "mb"], ["rank", "step"]), "rank", "step", 2).orderBy("interval_no").collect()
    first, second = (r.asDict() for r in got)
    close = pytest.approx
    assert first == {
        "interval_no": 0, "interval_steps": 3, "microbatch_unique_dataset_mean": close(5 / 4), "microbatch_dominant_ratio_mean": close(3.5 / 4), "microbatch_padding_ratio_mean": close((0.25 + 0 + 0 + 0.5) / 4), "microbatch_max_duration_mean": close(11 / 4),
        "global_step_unique_dataset_mean": close(4 / 3), "global_step_dominant_ratio_mean": close((2 / 3 + 1 + 1) / 3), "global_step_padding_ratio_mean": close((1 - 9 / 11 + 0 + 0.5) / 3), "global_step_cost_mean": close((11 + 10 + 12) / 3), "global_step_cost_max": 12.0,
        "global_step_max_duration_mean": close(9 / 3), "replacement_rate": close(1 / 6), "rank_cost_mean": close((10.5 + 12) / 2), "rank_cost_std": close(0.75), "rank_cost_max": 12.0,
    }
    assert (second["interval_steps"], second["rank_cost_mean"], second["rank_cost_std"], second["global_step_cost_max"]) == (1, 1.0, 0.0, 1.0)


def test_number_types_that_are_unknown(spark):
    row = spark.createDataFrame([("int3",)], "name string")
    with pytest.raises(Exception, match="unknown number type int3"):
        row.select(fields.resolved_dtype(F.col("name"), F.lit(False), F.lit(False))).collect()
    with pytest.raises(Exception, match="unknown number type int3"):
        row.select(fields.mixed_precision_dtype(F.col("name"), F.lit(True), F.lit(False))).collect()
    assert row.select(fields.mixed_precision_dtype(F.col("name"), F.lit(False), F.lit(False))).collect()[0][0] is None


def test_blank_keys_take_the_files(spark):
    assert column(spark, fields.dataset_key, [" A_en\u3000", "\u00a0", "", None], "string") == ["a_en", None, None, None]


def test_jsonl_in_splits(spark, tmp_path):
    rng = random.Random(2)
    for name in ("a.jsonl", "in/b c+d.jsonl", "in/skip.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\n".join(("é" * rng.randint(0, 90) + "\r" * (i % 7 == 0)).encode() for i in range(400)) + b"\n" * (name != "a.jsonl"))
    expected = {}
    for name in ("a.jsonl", "in/b c+d.jsonl"):
        at = 0
        for number, line in enumerate((tmp_path / name).read_bytes().split(b"\n"), 1):
            if text := line.decode().strip():
                expected[str(tmp_path / name), number] = (at, text)
            at += len(line) + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = jsonl.read_offsets(spark, str(tmp_path))
        got = {(r["source_path"], r["line_no"]): (r["byte_offset"], r["raw"]) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == expected
    wanted = [(p, at) for (p, _), (at, _) in expected.items()] + [(str(tmp_path / "a.jsonl"), 10**9), (None, 3)]
    lines = {(r["source_path"], r["byte_offset"]): r["raw"] for r in jsonl.read_at(spark.createDataFrame(wanted, "source_path string, byte_offset long")).collect()}
    assert lines.pop((str(tmp_path / "a.jsonl"), 10**9)) is None
    assert {k: v.strip() for k, v in lines.items()} == {(p, at): text for (p, _), (at, text) in expected.items()}
    assert jsonl.read_offsets(spark, str(tmp_path / "no*")).count() == 0


def test_trainability_errors():
    for config in ({"text_decoder_layer_indices": []}, {"text_decoder_layer_indices": [1, 1]}, {"text_decoder_layer_indices": [0]}, {"text_decoder_top_layers": 29}, {"text_decoder_top_layers": -1}):
        with pytest.raises(ValueError):
            parameters.trained_layers(config, 28)


def test_tied_embeddings(spark):
    names = ["thinker.model.embed_tokens.weight", "thinker.lm_head.weight"]
    head = {"lm_head": True}
    assert column(spark, lambda n: parameters.is_trained(n, head, 2, tied=True), names) == [True, True]
    assert column(spark, lambda n: parameters.is_trained(n, head, 2), names) == [False, True]


def test_features_of_any_size(spark):
    rows = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], "x"), (1, [[5.0], [6.0]], "y"), (1, None, "z"), (1, [], "e"), (2, None, "n")], "batch int, f array<array<double>>, width string")
    got = {r["width"]: (r["input_features"], r["feature_length"], r["feature_attention_mask"]) for r in collate.collated_features(rows, "batch", "f").collect()}
    assert got == {"x": ([[1, 2], [3, 4]], 2, [1, 1]), "y": ([[5, 0], [6, 0]], 1, [1, 0]), "z": (None, 0, [0, 0]), "e": ([], 0, [0, 0]), "n": (None, 0, [])}


def test_layers_by_list_or_number():
    assert parameters.picked_layers([3, 1], 4) == [2, 0] and parameters.picked_layers(None, 4, 3) == [0, 1, 2]
    for layers, first in (([5], None), ([1, 1], None), (None, 0), (None, 5), (None, None)):
        with pytest.raises(ValueError):
            parameters.picked_layers(layers, 4, first)


def test_tokenizers(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "tokenizer.json"))
    words = tokens.FileTokenizer(str(tmp_path))
    values = ["b a  c", "", None, "ａ"]
    df = spark.createDataFrame([(v, "en", "w") for v in values], "v string, code string, ids string")
    got = df.select(tokens.encoded(F.col("v"), words), tokens.encoded(F.col("v"), words, F.col("code")), tokens.encoded(F.col("v"), tokens.ByteTokenizer())).collect()
    assert [tuple(r) for r in got] == [([1, 0, 2], [1, 0, 2], list(b"b a  c")), (None, None, None), (None, None, None), ([2], [0], list("ａ".encode()))]
    assert column(spark, lambda v: tokens.decoded(v, words), [[1, 0], [], None, [3], [-1], [None]], "array<long>") == ["b a", "", None, None, None, None]
    meta = words.vocab_meta()
    (tmp_path / "special_tokens_map.json").write_text("{}")
    assert meta["base_vocab_size"] == 3 and meta["tokenizer_fingerprint"] != words.vocab_meta()["tokenizer_fingerprint"]
    with pytest.raises(ValueError):
        tokens.FileTokenizer(" ")
