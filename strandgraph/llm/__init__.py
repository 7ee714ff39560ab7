"""Training-data operators: quality, deduplication, tokenization, mixing, privacy and scoring.

Nothing outside this subpackage imports it.  ``registry`` lists the queries and
their SQL; every operator module also has a general interface of its own.
"""
