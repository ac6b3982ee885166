"""op11: prices of languages without kept terms, whatever order Spark joins in."""

from pyspark.sql import functions as F

from harvestry.llm import divergence


def test_a_language_without_terms_has_prices(spark):
    """A join may price its rows before it drops them; a price of nothing once divided by zero."""
    groups = spark.createDataFrame([("de", 0, 0), ("en", 4, 2)], "lang string, total long, v long")
    priced = groups.select("lang", divergence._p("0", "total").alias("p"))
    assert sorted(map(tuple, priced.select("lang", F.col("p").cast("long")).collect())) == [("de", 1000000001), ("en", 166666667)]
