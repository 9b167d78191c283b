"""Readers and writers: payload lines, capture files, saved tables."""
