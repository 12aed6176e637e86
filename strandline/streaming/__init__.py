"""Structured Streaming forms of pooling, segmentation and gallery look-ups."""
