"""Actloom: document-to-feature analytics expressed as Spark DataFrame jobs."""
