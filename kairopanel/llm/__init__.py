"""Operators for building training data from text corpora.

Nothing outside this package imports it; the queries are in :mod:`kairopanel.llm.queries`.
"""
