"""Training-data operators: packing, mixing, search, scans, deduplication, token files.

Each module holds one operator with its own general interface; ``catalog``
registers one query per operator. Nothing outside this folder imports it.
"""
