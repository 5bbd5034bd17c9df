"""Operators for preparing training text: dedup, mixing, formatting, filtering, extraction, tokenising.

Nothing outside this package imports it, so a deployment can leave it out.
"""
