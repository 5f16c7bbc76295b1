"""Whole plans: the report of a document against a job, and the registered queries."""
