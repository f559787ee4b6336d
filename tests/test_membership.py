import pytest
from pyspark.sql import functions as F

from scanweave.operators.membership import MAX_BITS, filter_shape, maybe_member, pass_rate


@pytest.mark.parametrize("n", [0, 1, 1000, 200_000])
def test_members_pass_and_few_others(spark, n):
    members = spark.range(n).select("id")
    rows = spark.range(2 * n + 50_000).withColumn("text", F.lit("kept"))
    counts = maybe_member(rows, [F.col("id")], members, [F.col("id")], "maybe").groupBy((F.col("id") < n).alias("inside"), "maybe").count().collect()
    counts = {(r.inside, r.maybe): r["count"] for r in counts}
    assert counts.get((True, False), 0) == 0 and counts.get((True, True), 0) == n
    others = n + 50_000
    assert abs(counts.get((False, True), 0) / others - pass_rate(n)) < 0.005


def test_nulls_and_columns(spark):
    rows = spark.createDataFrame([(None, "x"), (1, "y"), (2, None)], "id long, text string")
    found = maybe_member(rows, [F.col("id")], rows.where("id IS NULL"), [F.col("id")], "maybe")
    assert found.columns == ["id", "text", "maybe"]
    assert {r.id for r in found.where("maybe").collect()} == {None}


def test_pass_rate_by_formula():
    for members in (10, 10**4, 10**6, 10**7):
        assert pass_rate(members) < 0.03, members
    assert 0.2 < pass_rate(10**8) < 0.7
    for members in (0, 1, 10**6, 10**8, 10**11):
        words, per_member = filter_shape(members)
        assert 64 * words <= MAX_BITS and 1 <= per_member <= 3
