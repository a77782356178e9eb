"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
registers the thin contract queries over the driver's tables.
"""
