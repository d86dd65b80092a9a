"""Training-data operators: scoring, cleaning, deduplication and packing of text corpora."""
