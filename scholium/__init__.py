"""Ranking, evaluation and meta-learning analytics over scholarly works, on Spark DataFrames."""
