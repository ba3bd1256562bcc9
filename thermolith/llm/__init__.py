"""Training-data operators: packing, search, mixing, near and exact duplicates,
chat formatting, sharding, binary records, quality scores, page extraction.

Nothing outside this subpackage imports it.
"""
