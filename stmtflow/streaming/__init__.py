"""Structured Streaming jobs over a growing statement log.

Event time is the start of a statement. Keyed jobs take the rows of a micro-batch in arrival order, so
they equal the batch operators when files arrive in order; keys idle for long are evicted.
"""
