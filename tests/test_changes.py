"""The change queries read the whole log, however many events it has."""

import pytest

from terravane.plans import changes as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def late(spark, tmp_path):
    """The given tables with every event's id moved behind the first 4000."""
    for t in ("orders", "part", "events"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        # 31 * 200: ids that are a multiple of 31 have no entity
        (df.withColumn("event_id", df["event_id"] + 6200) if t == "events" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", [plans.impact, plans.incremental])
def test_late_events_count_as_early_ones(spark, late, query):
    got, want = ([tuple(r) for r in query(spark, d).collect()] for d in (late, DATA))
    assert want and sorted(got, key=repr) == sorted(want, key=repr)
