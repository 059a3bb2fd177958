"""Readers and writers of document collections."""
