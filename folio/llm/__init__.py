"""Corpus operators for training data: packing, fingerprints, mixing, near and exact duplicates, quality, URL rules.

Nothing outside this subpackage imports it.
"""
