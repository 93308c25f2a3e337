"""Operators for large text corpora: ten independent DataFrame operators and their queries."""
