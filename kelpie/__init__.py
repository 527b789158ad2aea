"""Kelpie: hybrid recall, reporting and data processing over a project's knowledge base, on Spark."""
