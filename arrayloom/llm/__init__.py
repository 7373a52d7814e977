"""Training-data pipeline operators: text, dedup, packing, search and mixing.

Nothing else in the library imports this subpackage.
"""
