"""Training-data operators: packing, filtering, deduplication, scans and search.

Nothing else in the library imports this subpackage.
"""
