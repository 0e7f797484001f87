"""Operators for preparing large text corpora, each over DataFrames.

Nothing else in the package imports this subpackage; its queries are listed
in :mod:`tarmac.llm.queries`.
"""
