"""Operators on transcripts, corpora and speaker vectors for building training data.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
