"""Fact analytics over replicated command logs, expressed as Spark DataFrames."""
