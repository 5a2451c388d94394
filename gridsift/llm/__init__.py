"""Operators for text corpora: encoding, filtering, matching and archiving."""
