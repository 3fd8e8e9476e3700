"""Incremental ingestion of growing folders."""
