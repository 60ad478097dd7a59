from __future__ import annotations

from tapeloom.llm import abuse, models


def test_a_model_is_fitted_once_per_state_of_its_tables(spark, tmp_path):
    fits = []
    fit = lambda: fits.append(1) or {"fit": len(fits)}
    spark.range(3).write.parquet(str(tmp_path / "t"))
    table = lambda: spark.read.parquet(str(tmp_path / "t"))
    assert models.shared(spark, "m", [table()], fit) == models.shared(spark, "m", [table()], fit) == {"fit": 1}
    assert models.shared(spark, "other", [table()], fit) == {"fit": 2}
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert models.shared(spark, "m", [table()], fit) == {"fit": 3}


def test_a_classifier_survives_saving(spark, tmp_path):
    texts = ["You are a worthless idiot.", "The bus leaves at noon.", None]
    model = abuse.fit([texts[0]] * 3, [texts[1]] * 9)
    models.save(spark, model, str(tmp_path / "model"))
    assert models.load(spark, str(tmp_path / "model")).scores(texts) == model.scores(texts)
