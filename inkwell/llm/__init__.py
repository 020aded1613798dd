"""Training-data operators: dedup, decontamination, scoring, mixing, sharding.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
