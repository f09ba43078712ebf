"""Schemas, keyed tables and readers of captured stores and brand lists."""
