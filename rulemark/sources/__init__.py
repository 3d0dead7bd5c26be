"""Readers of filings, universes and listings, domain views, and sinks."""
