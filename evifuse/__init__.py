"""Evidence fusion on Spark: DataFrame-in, DataFrame-out operators."""
