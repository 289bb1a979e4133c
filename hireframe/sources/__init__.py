"""Scans, loaders and sinks (S1-S11) and the fixture views over the test tables."""
