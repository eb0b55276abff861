"""The sample of pivots is limited by each task before it is shuffled."""


def test_tasks_limit_the_sample(spark):
    from mediaquarry.operators import neighbours

    refs = spark.range(5000).selectExpr("id as ref", "array(double(id), 1.0D) as reference")
    cells = neighbours.Pivots(refs, ["ref"], "ref", False)
    assert len(cells.pivots[2]) == neighbours.PIVOTS and neighbours.SAMPLED * neighbours.PIVOTS < int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    assert sum(cells.count.values()) == 5000
