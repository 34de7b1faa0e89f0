"""Training-data operators: mixing, sharding, deduplication, filters, counts.

Nothing outside this subpackage imports it. ``queries`` registers one query per
operator; each operator module keeps its own, more general interface.
"""
