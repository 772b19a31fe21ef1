"""Training-data operators: deduplication, filtering, mixing, formatting, packing."""
