"""Tidemark: text-corpus curation, retrieval and fact reconciliation on Spark."""
