"""Operators over DataFrames of sequences, pairs, scores, points and events."""
