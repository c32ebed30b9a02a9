"""Readers and writers for logs, exports and processed tables."""
