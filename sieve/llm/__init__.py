"""Operators of a training-data pipeline: language ID, nearest neighbours, SimHash near-duplicates, source
mixing, WARC, packing, sharding, exact top-k, toxicity and token files.

Nothing else in the library imports this package. Its queries and oracle SQL are in ``sieve.llm.catalog``.
"""
