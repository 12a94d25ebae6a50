"""Spark-first retrieval, ingestion and reporting operators for document corpora."""
