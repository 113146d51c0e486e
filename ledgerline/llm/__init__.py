"""Training-data operators: deduplication, search, formatting, scoring, mixing, packing."""
