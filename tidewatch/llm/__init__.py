"""Operators of a training-data pipeline (filters, dedup, mixing, packing, search).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""
