"""Training-data operators: scans, counts, models, packing, search and deduplication of text."""
