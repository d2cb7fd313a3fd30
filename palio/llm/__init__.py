"""Training-data operators: filtering, deduplication, encoding and packing of text corpora.

Nothing outside this subpackage imports it.
"""
