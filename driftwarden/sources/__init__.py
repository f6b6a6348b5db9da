"""Readers, writers, and tables derived from an event stream."""
