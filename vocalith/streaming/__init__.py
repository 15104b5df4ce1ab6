"""Stateful operators on Structured Streaming, and the state machines in them."""
