import pytest
from pyspark.sql import functions as F

from oracle import same
from skeinwork.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    same(spark, sf_dir, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_streamed_windows_are_all_there(spark, sf_dir):
    rows = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, sf_dir).withColumn("start", F.col("start").cast("timestamp")).select("start", "event_type", "n").collect()))
    assert rows("z_stream_tumbling") == rows("z_tumbling")
