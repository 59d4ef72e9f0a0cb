"""Training-data operators: mixing, packing, fingerprints, deduplication, scans and filters.

Each module holds one operator with a general interface; ``queries`` applies
them to the driver's tables. Nothing outside this folder imports it.
"""
