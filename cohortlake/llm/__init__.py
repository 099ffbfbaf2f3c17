"""Training-data operators: tokens, secrets, near-duplicates, mixing, shards, quality, licences.

Nothing else in the library imports this package; ``queries`` holds its registered queries.
"""
