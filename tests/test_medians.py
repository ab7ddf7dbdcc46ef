import random
import statistics

from pyspark.sql import functions as F

from boxloom.operators import quality as Q


def test_medians_of_wide_and_hot_values(spark):
    rng = random.Random(2)
    rows = {
        "wide": [rng.randint(-(1 << 52), 1 << 52) for _ in range(501)],
        "even": [rng.randint(0, 10 ** 9) for _ in range(500)],
        "hot": [7] * 400 + [rng.randint(0, 9) for _ in range(99)],
        "two": [-3, 4],
        "one": [5],
    }
    df = spark.createDataFrame([(m, v) for m, vs in rows.items() for v in vs] + [("one", None)], "measure string, v bigint")
    got = {r.measure: r for r in Q.value_statistics(df).collect()}
    assert set(got) == set(rows)
    for m, vs in rows.items():
        assert got[m].median == statistics.median(vs)
        assert (got[m].min, got[m].max) == (min(vs), max(vs))
        assert abs(got[m].std - (statistics.stdev(vs) if len(vs) > 1 else 0)) <= 1e-9 * max(1, abs(got[m].std))


def test_many_distinct_values(spark):
    """A hundred thousand distinct values and no buckets of more than one step in a task."""
    df = spark.range(100_001).select(F.lit("m").alias("measure"), (F.col("id") * 104_729).alias("v"))
    assert Q.value_statistics(df).first()["median"] == 50_000 * 104_729


def test_no_values(spark):
    assert Q.value_statistics(spark.createDataFrame([], "measure string, v bigint")).count() == 0
