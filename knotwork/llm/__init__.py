"""Operators for preparing language-model training data at scale.

Nothing outside this package imports it; the queries that the driver runs are in
``knotwork.llm.queries``.
"""
