"""Training-data operators: near-dedup, filters, mixing, packing, media and language ID.

Nothing else in the library imports this package.
"""
