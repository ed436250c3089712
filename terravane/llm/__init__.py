"""Training-data operators: mixing, near-duplicate search, filters, models and tokenizers."""
