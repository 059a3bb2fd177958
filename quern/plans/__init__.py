"""Declared pipelines, and the queries registered over the test tables."""
