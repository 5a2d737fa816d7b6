import pytest

from factweave import catalog
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, SF, catalog.QUERIES[name], catalog.SQL[name])


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.SQL.keys()


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert catalog.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("parts", ["1", "8"])
def test_results_do_not_depend_on_partitions(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for name in ("symbol_winner", "issue_dedup", "baseline_consume", "transitive_closure", "contiguous_ranges"):
            same(spark, SF, catalog.QUERIES[name], catalog.SQL[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
