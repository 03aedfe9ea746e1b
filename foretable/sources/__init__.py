"""Readers and writers, and the panels that are made from raw readings."""
