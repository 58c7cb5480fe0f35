"""Queries in the note query language on tables that the smallest files don't show."""

import math

from tarn import language_queries


def test_logs_of_large_groups(spark, tmp_path):
    """The product of a group's sizes leaves the range of doubles; the sum of their logarithms does not."""
    rows = [(i, f"name {i}", "Brand#11", f"kind {i % 3}", 50, 1.0) for i in range(1000)]
    columns = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "part.parquet"))
    (found,) = language_queries.language_group_values(spark, str(tmp_path)).collect()
    assert math.isclose(found["logs"], round(1000 * math.log(50), 4), abs_tol=1e-4) and found["least"] == 0 and found["kinds"] == 3
