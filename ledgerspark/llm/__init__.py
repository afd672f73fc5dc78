"""Training-data operators: deduplication, mixing, scoring, encoding, filtering and formatting of document tables."""
