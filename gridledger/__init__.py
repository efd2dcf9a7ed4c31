"""Spark jobs for test-tracking data."""
