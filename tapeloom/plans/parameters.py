"""Queries on model parameters as relations of names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.plans.registry import query

#: A parameter list like a model's: encoder and decoder layers, projections, embeddings and adapters.
PARAMETERS_SQL = """SELECT 'audio_tower.layers.' || i || '.' || leaf AS name, CAST((i + 1) * 1000 + length(leaf) AS BIGINT) AS numel FROM range(18) r(i), (VALUES ('attn.weight'), ('mlp.weight'), ('norm.bias')) v(leaf)
  UNION ALL SELECT 'model.layers.' || i || '.' || leaf, CAST((i + 1) * 2000 + length(leaf) AS BIGINT) FROM range(28) r(i), (VALUES ('q_proj.weight'), ('q_proj.lora_A'), ('mlp.weight')) v(leaf)
  UNION ALL SELECT n, CAST(length(n) * 5000 AS BIGINT) FROM (VALUES ('audio_tower.proj1.weight'), ('audio_tower.conv1.weight'), ('model.embed_tokens.weight'), ('lm_head.weight')) v(n)"""
_INDEX = r"(?:^|\.)layers\.(\d+)\."


def parameters(spark):
    encoder = spark.range(18).select(F.explode(F.array(*map(F.lit, ("attn.weight", "mlp.weight", "norm.bias")))).alias("leaf"), "id").select(F.concat(F.lit("audio_tower.layers."), F.col("id").cast("string"), F.lit("."), "leaf").alias("name"), ((F.col("id") + 1) * 1000 + F.length("leaf")).alias("numel"))
    decoder = spark.range(28).select(F.explode(F.array(*map(F.lit, ("q_proj.weight", "q_proj.lora_A", "mlp.weight")))).alias("leaf"), "id").select(F.concat(F.lit("model.layers."), F.col("id").cast("string"), F.lit("."), "leaf").alias("name"), ((F.col("id") + 1) * 2000 + F.length("leaf")).alias("numel"))
    rest = spark.createDataFrame([(n, len(n) * 5000) for n in ("audio_tower.proj1.weight", "audio_tower.conv1.weight", "model.embed_tokens.weight", "lm_head.weight")], "name string, numel long")
    return encoder.unionByName(decoder).unionByName(rest)


def layer_index(name):
    return F.regexp_extract(name, _INDEX, 1).try_cast("long")


_KEPT = (1, 2, 3, 5, 7, 9, 11, 13, 15, 17, 18)


def picked_layers(layers: list[int] | None, depth: int, first: int | None = None) -> list[int]:
    """0-based encoder layers from a 1-based list: in range, without repeats, order kept; without a list the first ones."""
    if layers is None:
        if first is None or not 1 <= first <= depth:
            raise ValueError(f"from 1 to {depth} layers can be kept, not {first}")
        return list(range(first))
    if len(set(layers)) != len(layers) or any(not 1 <= x <= depth for x in layers):
        raise ValueError(f"layers must be distinct and from 1 to {depth}")
    return [x - 1 for x in layers]


@query(f"SELECT CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS new_layer, CAST(unnest(l) - 1 AS BIGINT) AS old_layer FROM (SELECT {list(_KEPT)} AS l)")
def layer_selection(spark, folder):
    kept = F.array(*(F.lit(x).cast("long") for x in picked_layers(list(_KEPT), 18)))
    return spark.range(1).select(F.posexplode(kept).alias("p", "old_layer")).select(F.col("p").cast("long").alias("new_layer"), "old_layer")


@query(
    f"""WITH k AS (SELECT generate_subscripts(l, 1) - 1 AS new, unnest(l) - 1 AS old FROM (SELECT {list(_KEPT)} AS l)),
      p AS (SELECT name, TRY_CAST(nullif(regexp_extract(name, '^audio_tower\\.layers\\.(\\d+)\\.', 1), '') AS BIGINT) AS layer FROM ({PARAMETERS_SQL}))
      SELECT name, CASE WHEN layer IS NULL THEN name ELSE regexp_replace(name, '^audio_tower\\.layers\\.\\d+\\.', 'audio_tower.layers.' || new || '.') END AS new_name FROM p LEFT JOIN k ON layer = old WHERE layer IS NULL OR new IS NOT NULL"""
)
def layer_remap(spark, folder):
    names = parameters(spark).select("name", F.regexp_extract("name", r"^audio_tower\.layers\.(\d+)\.(.*)$", 1).try_cast("long").alias("old_layer"), F.regexp_extract("name", r"^audio_tower\.layers\.(\d+)\.(.*)$", 2).alias("leaf"))
    joined = names.join(F.broadcast(layer_selection(spark, folder)), "old_layer", "left").filter("old_layer is null or new_layer is not null")
    moved = F.concat(F.lit("audio_tower.layers."), F.col("new_layer").cast("string"), F.lit("."), "leaf")
    return joined.select("name", F.when(F.col("old_layer").isNull(), F.col("name")).otherwise(moved).alias("new_name"))


def trained_layers(config: dict, depth: int) -> list[int]:
    """0-based decoder layers that a configuration trains: all, the 1-based list, or the last ones."""
    if config.get("text_decoder", False):
        return list(range(depth))
    if (chosen := config.get("text_decoder_layer_indices")) is not None:
        if not isinstance(chosen, (list, tuple, set)) or not chosen:
            raise ValueError("layer indices must be a list with at least one number")
        return picked_layers([int(x) for x in chosen], depth)
    last = int(config.get("text_decoder_top_layers", 0) or 0)
    if not 0 <= last <= depth:
        raise ValueError(f"from 0 to {depth} layers can be trained, not {last}")
    return list(range(depth - last, depth))


def is_trained(name: Column, config: dict, depth: int, tied: bool = False) -> Column:
    """Whether a parameter is trained; what a configuration leaves out takes the value of its larger part.

    With `tied` embeddings, training the output layer trains the input embeddings.
    """
    flag = lambda key, default: bool(config.get(key, default))
    audio, text = flag("audio_tower", True), flag("text_decoder", False)
    bridge = flag("bridge", audio)
    head = flag("lm_head", False)
    layer = F.regexp_extract(name, r"^thinker\.model\.(?:model\.)?layers\.(\d+)(?:\.|$)", 1).try_cast("long")
    decoder = (
        F.when(F.lit(text) | name.contains("lora_"), True)
        .when(layer.isNotNull(), layer.isin(trained_layers(config, depth)) if trained_layers(config, depth) else F.lit(False))
        .when(name.rlike(r"^thinker\.model\.(model\.)?embed_tokens\."), flag("text_decoder_embeddings", text) or (tied and head))
        .when(name.rlike(r"^thinker\.model\.(model\.)?norm\."), flag("text_decoder_norm", text))
        .otherwise(False)
    )
    tower = "thinker.audio_tower."
    return (
        F.when(name.startswith(f"{tower}ln_post."), flag("bridge_ln_post", bridge))
        .when(name.startswith(f"{tower}proj1."), flag("bridge_proj1", bridge))
        .when(name.startswith(f"{tower}proj2."), flag("bridge_proj2", bridge))
        .when(name.startswith(tower), flag("audio_encoder", audio))
        .when(name.startswith("thinker.model."), decoder)
        .when(name.startswith("thinker.lm_head."), head)
        .otherwise(True)
    )


_CONFIGS = {
    "default": {},
    "adapters": {"audio_tower": False, "bridge_proj2": True, "text_decoder_top_layers": 2},
    "parts": {"audio_encoder": False, "bridge": False, "bridge_ln_post": True, "text_decoder_layer_indices": [1, 28], "text_decoder_norm": True, "lm_head": True},
    "text": {"audio_tower": False, "text_decoder": True},
}
_MORE_NAMES = ("thinker.audio_tower.ln_post.weight", "thinker.audio_tower.proj2.bias", "thinker.model.norm.weight", "thinker.model.model.layers.27.mlp.weight", "thinker.model.layers.x.bias", "thinker.model.rotary.scale", "distill.weight")


@query(
    f"""WITH n AS (SELECT 'thinker.' || name AS name FROM ({PARAMETERS_SQL}) UNION ALL SELECT unnest({list(_MORE_NAMES)})),
      c AS (SELECT * FROM (VALUES ('default', true, true, true, true, false, [-1], false, false), ('adapters', false, false, false, true, false, [26, 27], false, false),
        ('parts', false, true, false, false, false, [0, 27], true, true), ('text', false, false, false, false, true, [-1], true, false)) v(config, encoder, ln_post, proj1, proj2, whole, layers, norm, head)),
      l AS (SELECT *, TRY_CAST(regexp_extract(name, '^thinker\\.model\\.(model\\.)?layers\\.(\\d+)\\.', 2) AS INTEGER) AS layer FROM n)
      SELECT config, name, CASE WHEN starts_with(name, 'thinker.audio_tower.ln_post') THEN ln_post WHEN starts_with(name, 'thinker.audio_tower.proj1') THEN proj1 WHEN starts_with(name, 'thinker.audio_tower.proj2') THEN proj2
        WHEN starts_with(name, 'thinker.audio_tower.') THEN encoder WHEN starts_with(name, 'thinker.lm_head.') THEN head WHEN NOT starts_with(name, 'thinker.model.') THEN true WHEN whole OR contains(name, 'lora_') THEN true
        WHEN layer IS NOT NULL THEN list_contains(layers, layer) WHEN name = 'thinker.model.norm.weight' THEN norm ELSE false END AS trainable FROM l, c"""
)
def trainability(spark, folder):
    names = parameters(spark).select(F.concat(F.lit("thinker."), "name").alias("name")).unionByName(spark.createDataFrame([(n,) for n in _MORE_NAMES], "name string"))
    each = F.array(*(F.struct(F.lit(k).alias("config"), is_trained(F.col("name"), c, 28).alias("trainable")) for k, c in _CONFIGS.items()))
    return names.select("name", F.inline(each)).select("config", "name", "trainable")


@query(f"SELECT CAST(sum(numel) AS BIGINT) AS total, CAST(sum(CASE WHEN contains(name, 'lora_') THEN numel ELSE 0 END) AS BIGINT) AS trainable, bool_or(contains(name, 'lora_')) AS has_adapter FROM ({PARAMETERS_SQL})")
def param_count(spark, folder):
    adapter = F.col("name").contains("lora_")
    return parameters(spark).agg(F.sum("numel").alias("total"), F.sum(F.when(adapter, F.col("numel")).otherwise(0)).alias("trainable"), F.bool_or(adapter).alias("has_adapter"))


@query(
    f"""WITH m AS (SELECT name FROM ({PARAMETERS_SQL}) UNION ALL SELECT 'model.layers.3.k_proj.base_layer.weight'),
      c AS (SELECT name FROM ({PARAMETERS_SQL}) UNION ALL SELECT 'model.layers.3.k_proj.weight' UNION ALL SELECT 'gone.weight')
      SELECT c.name, CASE WHEN c.name IN (SELECT name FROM m) THEN c.name WHEN regexp_replace(c.name, '\\.([^.]+)$', '.base_layer.\\1') IN (SELECT name FROM m) THEN regexp_replace(c.name, '\\.([^.]+)$', '.base_layer.\\1') ELSE c.name END AS new_name FROM c"""
)
def lora_rename(spark, folder):
    extra = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    model = parameters(spark).select("name").unionByName(extra("model.layers.3.k_proj.base_layer.weight"))
    saved = parameters(spark).select("name").unionByName(extra("model.layers.3.k_proj.weight", "gone.weight"))
    saved = saved.withColumn("wrapped", F.regexp_replace("name", r"\.([^.]+)$", ".base_layer.$1"))
    own = model.select("name", F.lit(True).alias("there"))
    other = model.select(F.col("name").alias("wrapped"), F.lit(True).alias("wrapped_there"))
    joined = saved.join(own, "name", "left").join(other, "wrapped", "left")
    return joined.select("name", F.when(F.col("there").isNull() & F.col("wrapped_there"), F.col("wrapped")).otherwise(F.col("name")).alias("new_name"))


@query("SELECT case_no, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM (VALUES (1, [1, 2], [1, 2, 3]), (2, [1, 4], [1, 2, 3]), (3, CAST([] AS INTEGER[]), [1])) v(case_no, a, b)")
def subset_check(spark, folder):
    rows = spark.createDataFrame([(1, [1, 2], [1, 2, 3]), (2, [1, 4], [1, 2, 3]), (3, [], [1])], "case_no int, a array<int>, b array<int>")
    return rows.select("case_no", (F.size(F.array_except("a", "b")) == 0).alias("subset"))


@query("SELECT s_suppkey, s_nationkey IS NULL OR n_nationkey IS NULL OR s_nationkey = n_nationkey AS compatible FROM supplier LEFT JOIN nation ON s_suppkey % 25 = n_nationkey")
def metadata_equality(spark, folder):
    from tapeloom.sources.tables import table

    suppliers, nations = table(spark, folder, "supplier", "s_suppkey", "s_nationkey"), table(spark, folder, "nation", "n_nationkey")
    joined = suppliers.join(nations, suppliers.s_suppkey % 25 == nations.n_nationkey, "left")
    same = F.col("s_nationkey").isNull() | F.col("n_nationkey").isNull() | (F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", same.alias("compatible"))
