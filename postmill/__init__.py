"""Posting analytics on Spark: extraction, ingest, selection and delivery tracking."""
