"""How the quality classifier's sample reaches the task that fits it."""

from sparkloom.llm import quality


def test_scan_and_features_do_not_run_in_the_fitting_task(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(8)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id bigint, quality int, toxic int")
    plan = quality.fitted(docs, labels)._jdf.queryExecution().executedPlan().toString()
    first, second = plan.index("MapInArrow"), plan.rindex("MapInArrow")
    assert "Exchange SinglePartition" in plan[first:second] and "Coalesce" not in plan


def test_only_weights_that_take_part_reach_the_driver(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "junk junk spam") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    found = quality.fitted(docs, labels).first()
    weights, thresholds = quality.train(docs, labels)
    assert 0 < sum(map(len, found)) < 10_000 and len(weights) == 1 << quality.BITS and 0 < (weights != 0).sum() < 50 and len(thresholds) == 2
