"""Operators for training-data corpora; nothing else in gridloom imports this."""
