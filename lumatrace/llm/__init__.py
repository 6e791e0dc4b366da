"""Training-data operators: tokenising, counting, packing, dedup, scoring, filtering and de-identification.

Nothing else in the library imports this subpackage.
"""
