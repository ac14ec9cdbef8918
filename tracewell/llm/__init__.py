"""Operators for preparing training text: near and exact duplicates, mixing, extraction, filters, encoding, scoring.

Nothing else in the library imports this subpackage.
"""
