import pytest
from pyspark.sql import functions as F

from sarmotion.functions.joins import attach, sifted


@pytest.fixture
def skewed(spark):
    """One group holds most rows."""
    rows = spark.range(0, 3000, 1, 12).select(
        F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10).alias("k"), "id"
    )
    groups = rows.groupBy("k").agg(F.count("id").alias("n"))
    return rows, groups


@pytest.mark.parametrize("bounded", [True, False])
def test_every_row_gets_its_group(skewed, bounded):
    rows, groups = skewed
    joined = attach(rows, groups, ["k"], bounded)
    assert joined.count() == 3000
    assert {r["k"]: r["n"] for r in joined.select("k", "n").distinct().collect()} == {0: 2400, 8: 300, 9: 300}


def test_unmatched_rows_survive_a_left_join(skewed):
    rows, groups = skewed
    joined = attach(rows, groups.where("k <> 0"), ["k"], how="left")
    assert joined.where("n IS NULL").count() == 2400


def test_single_row_needs_no_keys(skewed):
    rows, _ = skewed
    total = rows.agg(F.count("id").alias("n"))
    assert attach(rows, total, []).where("n = 3000").count() == 3000


def test_a_hot_group_is_split(spark, skewed):
    rows, groups = skewed
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        placed = attach(rows, groups, ["k"]).select("k", "id", F.spark_partition_id().alias("p")).collect()
        assert len({r["p"] for r in placed if r["k"] == 0}) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sifting_keeps_every_wanted_row_and_drops_most_others(spark):
    rows = spark.range(20_000).selectExpr("id % 100 as a", "id div 100 as b", "id")
    wanted = rows.where("id % 50 = 7").select("a", "b")
    kept = sifted(rows, wanted, ["a", "b"], 400)
    assert kept.columns == rows.columns
    found = {r["id"] for r in kept.collect()}
    assert found >= set(range(7, 20_000, 50)) and len(found) < 2500
    assert sifted(rows, wanted.limit(0), ["a", "b"], 400).count() == 0
    assert sifted(rows, wanted, ["a", "b"], 1).join(wanted, ["a", "b"]).count() == 400
    # The filter's size is bounded whatever is asked for.
    assert sifted(rows, wanted, ["a", "b"], 10**12).count() == 400
