"""Multi-model analytics as functions over Spark DataFrames."""
