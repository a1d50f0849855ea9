"""Operators for building training data: deduplication, filters, mixing, tokens.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
