"""Operators of a training-data pipeline: deduplication, search, tokenization,
scoring, formatting, filtering and packing of text corpora.

Nothing outside this subpackage imports it.  Each operator has a general
function with its own output; ``queries`` derives the registered results.
"""
