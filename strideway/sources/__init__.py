"""Readers and writers of n-gram, edge-list and time-stamped edge files."""
