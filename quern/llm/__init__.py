"""Training-data operators: cleaning, deduplication, scanning, packing and output of text corpora."""
