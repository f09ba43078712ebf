"""Spark-native lead qualification: URL and text expressions, rule chains, entity
resolution, scoring and page evidence as DataFrame plans."""
