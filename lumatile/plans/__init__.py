"""Registered queries and end-to-end pipelines."""
