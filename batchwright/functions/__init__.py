"""Expressions over keys and counters."""
