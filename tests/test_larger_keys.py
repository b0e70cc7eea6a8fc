"""Keys of more digits than the smallest tables have."""

from pyspark.sql import functions as F

from docweave.operators import text


def test_numbers_of_four_digits_and_more(spark):
    rows = spark.createDataFrame([(1, 7), (999, 12), (1000, 1), (59999, 1234), (12345678901, 1)], "a long, b long")
    node = F.concat(F.lit("32017R0745_"), text.padded(F.col("a").cast("string")), F.lit("."), text.padded(F.col("b").cast("string")))
    got = [r.h for r in rows.orderBy("a").select(text.human_reference(node).alias("h")).collect()]
    assert got == ["Article 1(7)", "Article 999(12)", "Article 1000(1)", "Article 59999(1234)", "Article 12345678901(1)"]
