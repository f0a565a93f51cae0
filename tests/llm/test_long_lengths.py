"""Bounds of lengths that share a step of their octave."""

from lattica.llm import packing


def test_bounds_of_long_lengths_are_real(spark):
    lengths = [100_001, 100_031, 1_000_001, 5, 70_001]
    df = spark.createDataFrame([(x,) for x in lengths], "n_words long")
    assert packing.bucket_bounds(df) == [5, 70_001, 100_031, 1_000_001]
    assert packing.bucket_bounds(df, 1) == [1_000_001]
