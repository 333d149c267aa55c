"""Relational operators over sequences, k-mers and pairs."""
