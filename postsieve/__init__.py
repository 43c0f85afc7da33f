"""Curation of captured job-board pages into a clean postings table, on Spark."""
