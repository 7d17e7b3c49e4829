"""Operators a training-data pipeline needs: packing, scans, tokens, dedup, search.

Nothing else in the package imports this subpackage.
"""
