"""Operators of a training-data pipeline: filters, deduplication, packing, tokens, language.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLES`` are what the entry module registers.
"""
