"""Training-data operators: deduplication, scanning, sharding, classification, tokenisation.

Nothing outside this subpackage imports it.  Each module keeps a general interface over any
table with an id and a text column; ``queries`` holds the thin registered queries.
"""
