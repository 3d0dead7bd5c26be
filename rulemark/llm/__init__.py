"""Operators for preparing language-model training data.

Each module holds one operator with a general DataFrame interface; the thin
contract queries over the driver's tables are in :mod:`rulemark.llm.queries`.
Nothing outside this folder imports it.
"""
