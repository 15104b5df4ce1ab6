"""Operators on segments, intervals, vectors and ledgers, as DataFrame transformations."""
