import __spark_entry__


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "taken_at", "overall"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 100


def test_plans_push_filters_and_prune_columns(spark):
    """The scan gets the filter and only the columns that are used; top-k needs no full sort."""
    from photonlake.operators.filters import Filter, apply_filter
    from photonlake.operators.ordering import page, photo_order

    photos = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnsRenamed({"o_orderkey": "id", "o_totalprice": "overall"})
    plan = page(apply_filter(photos, Filter(min_overall=1000.0)).select("id", "overall"), photo_order("overall"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan and "TakeOrderedAndProject" in plan
