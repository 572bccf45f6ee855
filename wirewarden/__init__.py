"""Spark jobs for redacting and contract-checking captured API traffic."""
