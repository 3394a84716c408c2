"""Coded-language analytics for large collections of job postings, on Spark."""
