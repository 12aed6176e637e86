"""Readers and writers of the shapes the engine works on."""
