"""Training-data operators: search, filtering, deduplication, mixing and formatting of text corpora at scale."""
