"""Models know every feature of a sample like those of the test tables."""

from pyspark.sql import functions as F

from clientele.llm import learning


def test_seventy_thousand_features_stay(spark):
    sample = spark.range(3).select(F.sequence(F.lit(1), F.lit(70000)).cast("array<bigint>").alias("features"))
    assert len(learning.active_features(sample)) == 70000
