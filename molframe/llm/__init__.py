"""Training-data operators: sharding, packing, deduplication, tokenising, scanning and filtering of text corpora.

Nothing else in the library imports this subpackage.
"""
