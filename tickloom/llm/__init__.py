"""Training-data operators: quality, dedup, decontamination, tokens, archives."""
