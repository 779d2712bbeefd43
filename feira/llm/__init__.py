"""Operators for preparing training data for language models.

Nothing outside this subpackage imports it, so it can be left out of a
deployment that only needs the retail analytics.
"""
