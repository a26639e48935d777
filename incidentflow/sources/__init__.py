"""Scans, sinks and the fixture tables derived from the shared test data."""
