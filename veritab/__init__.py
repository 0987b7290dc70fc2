"""veritab: published numbers, extracted, re-aggregated and graded with Spark DataFrames."""
