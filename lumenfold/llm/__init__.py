"""Training-data operators: scoring, scanning, packing, de-duplication and language models.

Each module holds one operator with its own general interface; ``queries``
registers the digest queries that apply them to the driver's tables.
"""
