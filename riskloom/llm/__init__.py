"""Operators on text corpora for training data: filtering, matching, mixing, packing, search.

Nothing outside this package imports it.  ``queries`` registers one query per operator.
"""
