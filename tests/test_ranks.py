import numpy as np
import pytest

from pyspark.sql import functions as F

from sarmotion.functions.ranks import by_index, from_bits, medians, order_statistics, with_ordered_bits


@pytest.mark.parametrize(
    "values",
    [
        np.random.default_rng(1).normal(size=5000),
        np.random.default_rng(2).integers(0, 3, 5000).astype(float),  # heavy ties
        np.concatenate([np.zeros(4000), [1e300], np.random.default_rng(3).exponential(size=999)]),
        -np.random.default_rng(6).exponential(size=3000) ** 9,
        1.0 + np.random.default_rng(7).integers(0, 5000, 4000) * 2.0**-52,  # apart in the last bits only
        np.array([4.0]),
        np.array([2.0, 1.0]),
    ],
)
def test_matches_a_sort(spark, values):
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    row = order_statistics(frame, [], "v", {"p99": by_index(0.99), **medians()}).first()
    ordered, n = np.sort(values), len(values)
    assert row["n"] == n
    assert row["p99"] == ordered[int((n - 1) * 0.99)]
    assert row["mid_lo"] == ordered[(n - 1) // 2]
    assert row["mid_hi"] == ordered[n // 2]


@pytest.mark.parametrize("bounded", [True, False])
def test_groups_are_independent(spark, bounded):
    rng = np.random.default_rng(4)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 4, 4000) ** 2, rng.normal(size=4000))]
    frame = spark.createDataFrame(rows, "k int, v double")
    for r in order_statistics(frame, ["k"], "v", medians(), bounded).collect():
        ordered = np.sort([v for k, v in rows if k == r["k"]])
        assert r["mid_lo"] == ordered[(len(ordered) - 1) // 2]


def test_bits_keep_order_and_value(spark):
    powers = [2.0**e for e in range(-1074, 1024)]
    near = [np.nextafter(p, d) for p in powers for d in (0.0, np.inf)]
    values = np.array([*powers, *near, 0.0, 5e-324, np.inf, 1.7976931348623157e308, *np.random.default_rng(5).normal(size=2000)])
    values = np.concatenate([values, -values])
    frame = with_ordered_bits(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", "b")
    rows = frame.withColumn("back", from_bits(F.col("b"))).collect()
    got = sorted(rows, key=lambda r: r["b"])
    assert [r["v"] for r in got] == sorted(values.tolist())
    assert all(r["back"] == r["v"] for r in rows)
    exact = {r["v"]: r["b"] for r in rows if r["v"] > 0}
    assert exact == {v: int(np.float64(v).view(np.int64)) for v in exact}
    nan = with_ordered_bits(spark.sql("select double('NaN') v"), "v", "b").first()["b"]
    assert nan > max(exact.values())
    assert with_ordered_bits(spark.sql("select -0.0D v union all select 0.0D"), "v", "b").select("b").distinct().count() == 1


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_the_column_is_made_once(spark, tmp_path, keys):
    spark.range(3000).selectExpr("id % 5 as k", "sin(id) as v").write.parquet(str(tmp_path / "v"))
    frame = spark.read.parquet(str(tmp_path / "v"))
    found = order_statistics(frame, keys, "v", {"p99": by_index(0.99), **medians()})
    assert found.count() == (5 if keys else 1)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
