"""Operators over the statement log, as DataFrame to DataFrame functions."""
