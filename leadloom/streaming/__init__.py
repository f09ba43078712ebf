"""Micro-batch ingest; an extension, as the batch plans are complete without it."""
