"""Whole runs: batch ingest and the analyst's scored view."""
