"""Training-data operators: deduplication, filtering, scanning, tokenising.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` derives the registered
query columns from them.
"""
