"""Training-data operators: quality, deduplication, decontamination, tokenisation, sharding."""
