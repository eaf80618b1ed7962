"""Training-data operators over text tables: dedup, encoding, sharding, mixing, quality, media.

Nothing else in the library imports this package.
"""
