"""The pN_ queries and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import fields
from tapeloom.llm import abuse, copies, languages, leaks, lookalikes, mixing, models, packing
from tapeloom.plans.records import KEY_SQL, stripped_sql
from tapeloom.sources.tables import table


def _stretches(spark, folder):
    documents = table(spark, folder, "documents", "doc_id", "text", "lang")
    model = models.shared(spark, "languages", [documents], lambda: languages.fit_on(documents, "text", "lang", "doc_id"))
    return documents, languages.stretches(documents, "doc_id", "text", model)


def p1_found(spark, folder):
    documents, marked = _stretches(spark, folder)
    return languages.found(documents, marked, "doc_id", "lang")


def p1_segments(spark, folder):
    return _stretches(spark, folder)[1]


def p1_documents(spark, folder):
    return languages.by_document(_stretches(spark, folder)[1], "doc_id")


def _copy_records(spark, folder):
    return copies.records(table(spark, folder, "manifest", "row_id", "text", "audio_ref"), table(spark, folder, "shard_lines", "line_id", "raw"))


def p2_found(spark, folder):
    return copies.found(_copy_records(spark, folder))


def p2_records(spark, folder):
    return copies.collapsed(_copy_records(spark, folder))


def p3_found(spark, folder):
    return lookalikes.found(table(spark, folder, "manifest", "row_id", "text", "gold_text"), "row_id", ["text", "gold_text"])


def p3_canonical(spark, folder):
    rows = lookalikes.with_canonical(table(spark, folder, "manifest", "row_id", "text", "gold_text"), {"text": "text_form", "gold_text": "gold_form"})
    return rows.select("row_id", "text_form", "gold_form", (F.col("text_form") == F.col("gold_form")).alias("same"))


def _mix_inputs(spark, folder):
    return table(spark, folder, "manifest", "row_id", "source_path", "dataset_key"), table(spark, folder, "dataset_specs"), table(spark, folder, "mix_plans")


def p4_selection(spark, folder):
    return mixing.selection(*_mix_inputs(spark, folder))


def p4_report(spark, folder):
    return mixing.budgets(*_mix_inputs(spark, folder))


def _token_inputs(spark, folder):
    """The records with their size in tokens: the stated number, else the listed ids, else nothing."""
    length = fields.length_proxy(F.lit(None).cast("double"), F.col("token_len"), F.col("token_ids")).cast("long")
    return table(spark, folder, "manifest", "row_id", "source_path", "dataset_key", length.alias("n_tokens")), *_mix_inputs(spark, folder)[1:]


def p4_token_selection(spark, folder):
    return mixing.selection(*_token_inputs(spark, folder), size="n_tokens")


def p4_token_report(spark, folder):
    return mixing.budgets(*_token_inputs(spark, folder), size="n_tokens")


def p4_totals(spark, folder):
    """Size, sources and sum of the shares of each plan of the report."""
    return p4_report(spark, folder).groupBy("plan_name").agg(F.sum("size").alias("size"), F.count("*").alias("sources"), F.round(F.sum("actual_share"), 9).alias("share"))


def p5_pieces(spark, folder):
    return packing.packed(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "pack_targets"))


def p5_containers(spark, folder):
    return packing.fills(p5_pieces(spark, folder), table(spark, folder, "pack_targets"))


def p5_shares(spark, folder):
    return packing.shares(p5_containers(spark, folder))


def p6_overlaps(spark, folder):
    return leaks.overlaps(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "eval_items", "item_id", "text"), "item_id", "text")


def p6_found(spark, folder):
    return p6_overlaps(spark, folder).select("doc_id", "item_id").distinct()


def p7_scores(spark, folder):
    documents = table(spark, folder, "documents", "doc_id", "source", "text")
    labels = table(spark, folder, "doc_labels")
    model = models.shared(spark, "abuse", [documents, labels], lambda: abuse.fit_on(documents, labels))
    return abuse.scored(documents, "doc_id", "text", model, keep=("source",))


def p7_found(spark, folder):
    return p7_scores(spark, folder).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p7_rates(spark, folder):
    return abuse.rates(p7_scores(spark, folder), "source")


def queries():
    return {"p1_found": p1_found, "p1_segments": p1_segments, "p1_documents": p1_documents, "p2_found": p2_found, "p2_records": p2_records, "p3_found": p3_found, "p3_canonical": p3_canonical, "p4_selection": p4_selection, "p4_report": p4_report, "p4_token_selection": p4_token_selection, "p4_token_report": p4_token_report, "p4_totals": p4_totals, "p5_pieces": p5_pieces, "p5_containers": p5_containers, "p5_shares": p5_shares, "p6_found": p6_found, "p6_overlaps": p6_overlaps, "p7_found": p7_found, "p7_scores": p7_scores, "p7_rates": p7_rates}


_FOLDED = r"lower(regexp_replace(replace({0}, 'ß', 'ss'), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}\p{{P}}]+', '', 'g'))"
_GROUPS = f"""WITH r AS (SELECT 'manifest' AS table_name, row_id AS id, text, audio_ref FROM manifest
    UNION ALL SELECT 'shard_lines', line_id, CASE WHEN good THEN raw ->> '$.text' END, CASE WHEN good THEN raw ->> '$.audio_ref' END FROM (SELECT *, regexp_matches(raw, '^\\s*\\{{') AND json_valid(raw) AS good FROM shard_lines)),
  f AS (SELECT table_name, id, {_FOLDED.format("text")} AS t, {_FOLDED.format("audio_ref")} AS a FROM r),
  g AS (SELECT table_name, id, min(id) OVER same AS first_id, count(*) OVER same AS n_copies FROM f WHERE t <> '' AND a <> '' WINDOW same AS (PARTITION BY table_name, t, a))"""


# what a plan adds up to: all sources share the total as long as there is room
_TOTALS = f"""WITH m AS (SELECT coalesce({KEY_SQL}, nullif(lower({stripped_sql("s.dataset_key")}), '')) AS source FROM manifest m LEFT JOIN dataset_specs s ON m.source_path = s.train_path),
  n AS (SELECT source, count(*) AS records FROM m WHERE source IS NOT NULL GROUP BY 1),
  s AS (SELECT nullif(lower({stripped_sql("dataset_key")}), '') AS source, max(CASE WHEN isnan(weight) THEN 0 ELSE weight END) AS weight, sum(greatest(count, 0)) AS declared FROM dataset_specs GROUP BY 1),
  u AS (SELECT s.source, s.declared, coalesce(n.records, 0) AS records FROM s LEFT JOIN n USING (source) WHERE s.source IS NOT NULL AND s.weight > 0 AND s.declared > 0)
  SELECT plan_name, CAST(least(round_even(size_factor * sum(declared), 0), max_repeats * sum(records)) AS BIGINT) AS size, count(*) AS sources, CAST(1 AS DOUBLE) AS share FROM mix_plans, u GROUP BY plan_name, size_factor, max_repeats"""


def oracle_sql():
    return {
        "p4_totals": _TOTALS,
        "p2_found": f"{_GROUPS} SELECT table_name, first_id, id AS copy_id FROM g WHERE id <> first_id",
        "p2_records": f"{_GROUPS} SELECT r.table_name, r.id, CAST(coalesce(g.n_copies, 1) AS BIGINT) AS n_copies FROM r LEFT JOIN g USING (table_name, id) WHERE g.first_id IS NULL OR g.first_id = r.id",
    }
