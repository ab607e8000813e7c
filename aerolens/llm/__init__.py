"""Training-data operators: sharding, filters, deduplication, decontamination, mixing, formatting, token files.

Every operator is a ``DataFrame -> DataFrame`` function over whole tables. ``queries`` holds the thin
registered queries, the operators' modules the methods.
"""
