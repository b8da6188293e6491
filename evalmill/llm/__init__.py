"""Training-data operators for text corpora: formatting, filtering, tokenizing, deduplication and packing."""
