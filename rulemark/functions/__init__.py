"""Column functions: identifiers, statistics, text."""
