"""End-to-end compositions (E1-E4) and the registered query catalogue."""
