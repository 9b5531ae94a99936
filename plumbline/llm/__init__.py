"""Training-data operators: near-duplicate joins, search, tokenizing, scoring, packing.

Nothing else in the library imports this subpackage.
"""
