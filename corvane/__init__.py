"""Corpus preparation, retrieval and feedback analytics as Spark jobs."""
