"""Training-data operators: matching, deduplication, extraction, tokenising, formatting and selection."""
