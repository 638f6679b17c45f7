"""Corpus, retrieval and training-data analytics on Spark DataFrames."""
