"""What op3's network learns from."""

from cadastra.llm import lm_scoring


def test_by_default_each_position_is_trained_on_once(spark, monkeypatch):
    texts = [f"the {i % 7} old mill by the river {i} stands" for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    averaged, used = lm_scoring._averaged, []

    def seen(copies, groups):
        if len(used) < 60 and set(copies.columns) == {"part", "weight", "flat"} and not getattr(copies, "_averaged", False):
            used.append(copies.selectExpr("sum(weight)").first()[0])
        out = averaged(copies, groups)
        out._averaged = True
        return out

    monkeypatch.setattr(lm_scoring, "_averaged", seen)
    lm_scoring.train(docs, lm_scoring.count_words(docs))
    assert sum(used) == sum(len(t.split()) for t in texts)
