"""Analytic views and reports, each a function from DataFrame to DataFrame."""
