import pytest

from brookmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["mail_records", "mail_signatures", "requirement_positions"])
def test_a_small_file_is_many_tasks(spark, name):
    rows = registry.QUERIES[name](spark, SF)
    assert rows.rdd.getNumPartitions() == max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
