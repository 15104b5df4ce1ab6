"""Readers and writers of the formats segments, results and audio come in."""
