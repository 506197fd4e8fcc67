"""Structured Streaming versions of the operators, built on the same batch functions."""
