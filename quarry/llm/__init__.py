"""Training-data operators: tokenised records, mixing, dedup, PII, quality, chat formatting and packing.

Nothing else in the library imports this subpackage.
"""
