"""Training-data operators: text quality, deduplication, archives, tokens and secrets.

Nothing else in the library imports this subpackage.
"""
