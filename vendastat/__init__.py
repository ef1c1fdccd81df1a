"""Retail order analytics as plain DataFrame-to-DataFrame Spark functions."""
