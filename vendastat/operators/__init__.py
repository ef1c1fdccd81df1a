"""Operators Spark has no single call for: skew-proof lookup join, global tiles, sampling."""
