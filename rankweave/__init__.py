"""Recommender analytics expressed as Spark jobs over DataFrames."""
