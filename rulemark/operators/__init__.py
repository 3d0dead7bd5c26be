"""Operators on long tables of holdings, prices, rules and samples."""
