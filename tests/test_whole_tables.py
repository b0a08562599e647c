"""Registered queries leave no row of their tables out. (``test_queries`` compares them with their SQL.)"""

from meridia.plans import registry

registry.load()


def test_no_query_is_cut_to_a_subset():
    cuts = ("orderkey % 20", "orderkey % 50", "orderkey % 40", "orderkey % 7 =", "orderkey % 3 =", "event_id % 15", "product < 20")
    for name, sql in registry.ORACLES.items():
        assert not any(cut in sql for cut in cuts), name


def test_queries_of_rows_give_every_row(spark, sf):
    rows = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").count()
    assert registry.QUERIES["leadlag_false_discovery"](spark, sf).count() == rows("orders")
    assert registry.QUERIES["filter_validity_mask"](spark, sf).count() == rows("events")
