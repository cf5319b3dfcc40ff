"""Operators for training-data corpora: dedup, filtering, counting, packing and audits of text at scale.

Nothing outside this folder imports it, so that it can be left out whole.
"""
