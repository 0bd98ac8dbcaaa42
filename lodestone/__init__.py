"""Lodestone: ranking, retrieval and corpus analytics as declarative Spark plans."""
