"""Operators for large text corpora: dedup, scoring, scanning, encoding and archive IO.

Nothing outside this subpackage imports it.
"""
