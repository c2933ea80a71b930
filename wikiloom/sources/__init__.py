"""Files and fetched responses as tables."""
