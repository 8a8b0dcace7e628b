"""Training-data operators: quality, deduplication, mixing, packing and scoring.

Nothing outside this subpackage imports it.
"""
