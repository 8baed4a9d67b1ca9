"""Incident-operations analytics on Spark: ingest, workflow reconstruction, scoring, checks and graph jobs."""
