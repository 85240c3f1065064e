"""Training-data operators: filters, duplicates, mixing, language models and token output."""
