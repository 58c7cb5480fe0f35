"""Lists and rows of links, with hubs."""

from pyspark.sql import functions as F

from tarn.operators import links


def test_lists_have_a_bound_if_one_is_given(spark):
    edges = spark.range(5000).select(F.format_string("n%04d", "id").alias("src"), F.when(F.col("id") < 4990, "hub").otherwise("rare").alias("dst"))
    edges = edges.union(edges)
    whole = {r.path: r.inlinks for r in links.inlinks(edges).collect()}
    assert len(whole["hub"]) == 4990 and whole["rare"] == [f"n{i}" for i in range(4990, 5000)]
    few = links.inlinks(edges, most=20)
    assert {r.path: r.inlinks for r in few.collect()} == {"hub": whole["hub"][:20], "rare": whole["rare"]}
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()
    assert links.link_rows(edges).count() == 5000 and links.outlinks(edges).where("size(outlinks) = 1").count() == 5000
