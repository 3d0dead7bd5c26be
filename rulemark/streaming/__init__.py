"""Incremental intake of filings."""
